"""Large ids beside null ones, and texts that once took quadratic time."""

import base64
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import neardup, packing, secret_scan
from footfall.llm.queries import tokenizer_path

BIG = 2**60
SCHEMA = "doc_id long, text string, n_chars long, other long"


@pytest.fixture(scope="module")
def docs(spark):
    """Ids that differ beyond what a double tells apart, next to null ones; so does another column."""
    texts = ["one two three four five six seven", "token = 'abcdefgh1234' and more", None, "", "one two three four five six seven"]
    rows = [(BIG + 2 * i + 1, t, None if t is None else len(t), BIG + 2 * i + 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", 5, None)], SCHEMA).coalesce(1)


WANTED = sorted([BIG + 1, BIG + 3, BIG + 5, BIG + 7, BIG + 9])


def test_ids_stay_whole(docs):
    ids = lambda df: sorted(r["doc_id"] for r in df.where("doc_id is not null").select("doc_id").distinct().collect())
    assert ids(secret_scan.scan(docs)) == WANTED
    assert ids(neardup.signed(docs)) == WANTED
    found = {r["doc_id"]: r["component_id"] for r in neardup.classes(docs).collect()}
    assert found[BIG + 9] == BIG + 1 and found[BIG + 3] == BIG + 3
    assert ids(packing.pack(docs, tokenizer_path())) == WANTED


def test_redaction_leaves_other_columns_whole(docs):
    got = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert sorted(x for x in got if x) == WANTED and sorted(r["other"] for r in got.values() if r["other"]) == WANTED
    assert "[SECRET]" in got[BIG + 3]["text"] and got[BIG + 3]["n_chars"] == len(got[BIG + 3]["text"])
    assert got[BIG + 5]["text"] is None and got[BIG + 5]["n_chars"] is None and got[BIG + 7]["text"] == ""


def test_deduplicated_keeps_large_ids(docs):
    assert {r["doc_id"] for r in neardup.deduplicated(docs).collect()} >= {BIG + 1, BIG + 3}


def _wrapped(data: bytes) -> str:
    line = base64.b64encode(data).decode()
    return "\n".join(line[i : i + 76] for i in range(0, len(line), 76))


def test_attachments_and_unclosed_keys_take_linear_time():
    began = time.perf_counter()
    assert secret_scan.confirmed_spans(_wrapped(np.random.default_rng(0).bytes(15_000_000))) == []
    assert secret_scan.confirmed_spans("-----BEGIN RSA PRIVATE KEY-----\nMIIE and so on\n" * 10_000) == []
    assert secret_scan.confirmed_spans("-----BEGIN RSA PRIVATE KEY-----\n" * 10_000) == []
    assert time.perf_counter() - began < 30


def test_key_after_a_mention_of_its_first_line():
    body = _wrapped(bytes(range(256)) * 2)
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0A' * 16}\n\n{body}\n-----END RSA PRIVATE KEY-----"
    for before in ("", "It begins with -----BEGIN RSA PRIVATE KEY----- and then:\n", "-----BEGIN RSA PRIVATE KEY-----\nthat one was cut\n"):
        text = before + key + " end"
        assert [s for s in secret_scan.confirmed_spans(text) if s[0] == "pem"] == [("pem", len(before), len(before) + len(key))]
        assert body[:40] not in secret_scan.redacted(text, secret_scan.confirmed_spans(text))


def test_pipeline_stage_keeps_null_ids(docs):
    assert secret_scan.redact(docs.withColumn("text", F.lit("password: hunter22"))).where("doc_id is null and text like '%[SECRET]%'").count() == 1
