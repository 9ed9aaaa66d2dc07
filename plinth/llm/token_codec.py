"""Operator 7: byte-pair encoding and decoding of whole texts.

Method: backtracking encoder (Aho-Corasick matches checked against a
pair-compatibility table) and offset-table decoder, see :mod:`plinth.llm.wordbpe`.
The work is a map over rows: no shuffle, and each row is independent of the others.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from plinth.llm.common import documents, map_texts
from plinth.llm.wordbpe import bpe, default_vocabulary

COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), want: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode ``text`` and decode the ids again; returns ``keep`` and the columns of ``want``.

    ``want`` may hold any of ``n_tokens``, ``ids``, ``decoded``, ``ids_sha256`` (of the
    decimal ids joined by a blank) and ``decoded_sha256`` (of the decoded text in UTF-8).
    Null and empty texts give no ids and an empty decoded text; texts of any length
    are encoded whole; repeated rows and equal keys each give a row; an empty table
    gives no rows; other columns are not read.
    """

    def kernel(texts: list) -> dict[str, list]:
        coder = bpe(vocabulary)
        out: dict[str, list] = {w: [] for w in want}
        for t in texts:
            ids = np.frombuffer(coder.encode_bytes(t), "<u4")
            if "n_tokens" in out:
                out["n_tokens"].append(len(ids))
            if "ids" in out:
                out["ids"].append(ids.astype(np.int32))
            if "ids_sha256" in out:
                out["ids_sha256"].append(hashlib.sha256(coder.decimals(ids)).hexdigest())
            if "decoded" in out or "decoded_sha256" in out:
                raw = coder.decode_bytes(ids)
                if "decoded" in out:
                    out["decoded"].append(raw.decode())
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
        return out

    return map_texts(docs, kernel, ", ".join(f"{w} {COLUMNS[w]}" for w in want), text, keep)


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded text of every document."""
    return encode_decode(documents(spark, sf_dir, "doc_id", "text"), default_vocabulary(), want=("n_tokens", "ids_sha256", "decoded_sha256"))
