"""Every stage of the corpus pipeline against plain Python on what it was given, and run() as the chain of them."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_text_data import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from sparktile.llm.quality_ordinal import score_texts
from sparktile.llm.queries import quality_model, tokenizer_file

TABLES = ("documents", "labels", "benchmark")
WORDS = "[^\\x20\\x09-\\x0D]+"


def planted(spark):
    """The small tables with null and repeated ids, odd texts, a null source and columns with clashing names."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    some = docs.orderBy("doc_id").limit(3).collect()
    plain = " ".join(f"word{i} stands in this plain and quiet sentence number {i}." for i in range(40))
    extra = [
        (None, None, "en", "a"), (None, plain, "en", None), (900001, "", "en", None), (900002, " \t\n", None, "b"), (900003, some[0].text, "en", "c"),
        (900004, some[1].text + " one more", "en", "c"), (900005, plain + " " + item + " " + plain, "en", "c"), (900006, plain, "de", "d"),
        (900006, plain, "de", "d"), (900006, plain[::-1], "de", "d"), (900007, "sentence after sentence " * 20_000, "en", "d"), (900008, None, None, None),
    ]
    rows = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows)
    return both.withColumns({c: F.lit("own") for c in ("source_id", "batch", "size", "copies", "kept", "kept_id", "bad_id", "document", "start")})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    planted(spark).write.parquet(f"{at}/documents.parquet")
    for name in TABLES[1:]:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def flow(spark, folder):
    """What each stage was given and what run() returned, from one run of the registered query."""
    seen, stages = {}, list(corpus_pipeline.STAGES)

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs.collect()
            return stage(spark, docs, sf_dir)

        return name, run

    corpus_pipeline.STAGES[:] = [watched(*s) for s in stages]
    try:
        seen["result"] = corpus_pipeline.run(spark, folder).collect()
    finally:
        corpus_pipeline.STAGES[:] = stages
    return seen


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_stages_and_columns(flow):
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n in flow if n != "result"]
    columns = flow["quality classifier"][0].__fields__
    assert all(flow[n][0].__fields__ == columns for n in flow if n != "result")
    assert len(flow["near duplicates"]) < len(flow["quality classifier"]) and len(flow["decontamination"]) < len(flow["near duplicates"])


def test_quality_stage(spark, folder, flow):
    model, given = quality_model(spark, folder), flow["quality classifier"]
    at = int(np.searchsorted(model.grades, 1))
    tail = score_texts(model, [r.text or "" for r in given])[:, at - 1] if at else np.ones(len(given))
    want = counted(r for r, p in zip(given, tail) if p >= 0.5)
    unsure = counted(r for r, p in zip(given, tail) if abs(p - 0.5) < 1e-9)
    got = counted(flow["near duplicates"])
    assert set((got - want) + (want - got)) <= set(unsure)


def test_near_duplicate_stage(flow):
    given = flow["near duplicates"]
    kept = {key for key, _, component in brute_components([(r.doc_id, r.text) for r in given], 5, 80) if key == component}
    assert counted(flow["decontamination"]) == counted(r for r in given if r.doc_id in kept)


def test_decontamination_stage(folder, flow):
    def words(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())

    windows = {}
    for text in pq.read_table(f"{folder}/benchmark.parquet")["text"].to_pylist():
        ws = words(text)
        n = min(10, len(ws))
        windows.setdefault(n, set()).update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1) if n)
    bad = set()
    for r in flow["decontamination"]:
        ws = words(r.text)
        if any(tuple(ws[i : i + n]) in held for n, held in windows.items() if n for i in range(len(ws) - n + 1)):
            bad.add(r.doc_id)
    assert bad and counted(flow["mixing"]) == counted(r for r in flow["decontamination"] if r.doc_id not in bad)


def test_mixing_stage(flow):
    given = flow["mixing"]
    size = [len(re.findall(WORDS, r.text or "")) for r in given]
    names = sorted({r.source for r in given}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, given) if r.source == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in full} | ({} if full else {s: weight[s] * level for s in free})
        left, free = left - sum(3 * total[s] for s in full), free - full if full else set()
    want, near = Counter(), set()
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, last = target[s] - whole * total[s], -1
        of = {}
        for n, r in zip(size, given):
            if r.source == s:
                h = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
                of.setdefault(h, []).append((n, r))
        used = 0
        for h in sorted(of):
            more = sum(n for n, _ in of[h])
            if used + more > rest:
                last = h if 2 * (rest - used) >= more and rest > 0 else last
                break
            used, last = used + more, h if rest > 0 else last
        for h, rows in of.items():
            for _, r in rows:
                want[tuple(r)] += whole + (h <= last)
    got = counted(flow["token pages"])
    assert +want == got, (list((+want - got).items())[:2], list((got - want).items())[:2])


def test_token_stage(flow):
    tokenizer, want = Tokenizer.from_file(tokenizer_file()), Counter()
    for r in flow["token pages"]:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(flow["result"], key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_empty_tables(spark, folder, tmp_path):
    for name in TABLES:
        schema = pa.schema([f.remove_metadata() for f in pq.read_table(f"{folder}/{name}.parquet").schema])
        pq.write_table(schema.empty_table(), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
