"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from tidemark.llm import collocations, decontaminate, embeddings, html, langid, mixing, pii, simhash, suffix_lm, tokens, toxicity, urls, whitening
from tidemark.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame function under its name, with its SQL where there is one."""
    if fn is None:
        return lambda f: query(f, sql=sql)
    QUERIES[fn.__name__] = fn
    if sql is not None:
        SQL[fn.__name__] = sql
    return fn


@query
def op1_simhash_pivots(spark, folder):
    marked = simhash.near_duplicates(table(spark, folder, "documents"))
    return marked.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op2_embedding_lsh(spark, folder):
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op3_token_counts(spark, folder):
    import public_tokenizers

    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(sql=urls.SQL)
def op4_url_rules(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


@query
def op5_toxicity(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_language(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query(sql=decontaminate.SQL)
def op7_benchmark_windows(spark, folder):
    return decontaminate.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_main_text(spark, folder):
    return html.extract(table(spark, folder, "pages"))


@query(sql=mixing.SQL)
def op9_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query
def op10_suffix_tree(spark, folder):
    return suffix_lm.score_documents(table(spark, folder, "documents"))


@query
def op11_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_personal_data(spark, folder):
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query(sql=collocations.SQL)
def op13_collocations(spark, folder):
    return collocations.mine(table(spark, folder, "documents"))
