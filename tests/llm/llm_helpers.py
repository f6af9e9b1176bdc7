from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    """A frame of (doc_id, text) or (doc_id, text, lang, source) rows, with columns besides whose names clash with an operator's own."""
    full = [(tuple(r) + ("en", "s"))[: max(4, len(r))][:4] + (None if r[1] is None else len(r[1]),) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("score", "shard", "size", "doc", "crc", "set", "hash", "length", "rank", "kept", "label", "_k0", "_nth", "words"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df
