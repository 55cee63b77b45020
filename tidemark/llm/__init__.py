"""Operators for preparing text corpora; nothing else in the package imports this subpackage."""


def queries():
    from tidemark.llm.corpus_queries import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from tidemark.llm.corpus_queries import ORACLES

    return dict(ORACLES)
