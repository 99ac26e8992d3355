"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from . import byte_bpe, embedding_dedup, exact_dedup, fill_middle, html_text, lexical_search, licenses, mixing, pii, secrets, simhash, toxicity, vector_search

QUERIES = {
    f.__name__: f
    for f in (
        embedding_dedup.op1_embedding_dedup,
        licenses.op2_license,
        simhash.op3_simhash,
        pii.op4_pii,
        toxicity.op5_toxicity,
        mixing.op6_mixing,
        html_text.op7_html_text,
        exact_dedup.op8_exact_dedup,
        byte_bpe.op9_byte_bpe,
        secrets.op10_secrets,
        fill_middle.op11_fill_middle,
        lexical_search.op12_lexical_search,
        vector_search.op13_vector_search,
    )
}

SQL = {
    "op1_embedding_dedup": embedding_dedup.OP1_SQL,
    "op2_license": licenses.op2_sql(),
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_secrets": secrets.op10_sql(),
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_vector_search": vector_search.OP13_SQL,
}
