"""All queries of this subpackage and the SQL to hold them against."""

from . import chat, decontaminate, html_text, line_dedup, ngram_join, packing, passages, quality, resample, sharding, spelling, token_files, topk

MODULES = (decontaminate, packing, quality, chat, line_dedup, ngram_join, token_files, passages, html_text, topk, resample, sharding, spelling)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
