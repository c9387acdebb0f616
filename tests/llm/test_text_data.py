"""Packing, near-duplicates, chat, decontamination, mixing, repeats: round trips, brute force, odd inputs."""

import hashlib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sparktile.llm import bit_packing
from sparktile.llm.bit_packing import PieceEncoder, bits_for, block_offsets, pack_ids, read_token_index, unpack_ids, write_token_pages
from sparktile.llm.chat import PART_TYPE, PartCosts, format_conversations, parse_conversations
from sparktile.llm.decontamination import find_contamination, words_of
from sparktile.llm.graph import connected_components
from sparktile.llm.induced_sort import ShardSorter
from sparktile.llm.minhash import near_duplicates
from sparktile.llm.mixing import batch_targets, mix_batches
from sparktile.llm.queries import tokenizer_file
from sparktile.llm.suffix_dedup import remove_repeats
from sparktile.session import scratch_path

CLASHING = "source_id long, text string, batch string, n_words string, kept string, row_key string, rank string, token string, item_id string, size string, spans string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "b", "x", "x", "x", "x", "x", "x", "x", "x") for i, t in texts], CLASHING)


ODD = [(1, None), (2, ""), (None, "null id text of its own"), (3, " \t\n"), (4, "x" * 150_000), (5, "same row twice here"), (5, "same row twice here"), (5, "same id, other text")]


# ---- token pages


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 1023, 1024, 1025, 70_000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        packed = pack_ids(ids, bits)
        offsets = block_offsets(n, bits)
        assert (unpack_ids(packed, bits, 0, n, offsets) == ids).all() and len(packed) <= n * bits // 8 + 1
        for a, b in ((n // 3, n // 2), (n - 1, n), (1000, 1030)):
            if 0 <= a < b <= n:
                assert (unpack_ids(packed, bits, a, b, offsets) == ids[a:b]).all()
    assert bits_for(50_257) == 16 and bits_for(1) == 1 and bits_for(65_537) == 17
    with pytest.raises(ValueError):
        pack_ids(np.array([4]), 2)


def test_pieces_encode_like_whole_texts():
    encoder = PieceEncoder.of(tokenizer_file())
    texts = ["a  b\n\nc", "it's, don't!! x.\n y", "  lead", "tail  ", "\n\n", "", " ", "é, ñ! ü\t. z", "a.b,c 12,5 x!y", "<|endoftext|> hi", "I'll, we've.\u0085 q", "a\x1c b\x1c,c", "日本 語. x"]
    end = "<|endoftext|>"
    texts += [end, end + end, f"hello {end} world", f"{end} a", f"a {end}", f"x.{end},y", f"two  {end}  \n{end}\n z", f"{end}!a", f"a{end}b c", "<|endof text|>"]
    fresh = Tokenizer.from_file(tokenizer_file())
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def test_only_distinct_words_and_marks_go_to_the_library(monkeypatch):
    words = [w + v for w in ("lorem", "thed", "\u00e9toil\u00e9", "\u017elut\u00fd") for v in "abcde"]
    marks = ["***", "###", "$$$", "%%%", "&&&", "|", ")", ";", ":", "?", '"', "/", "7", "12", "-", "=", "'s", "'ll"]
    texts = [f"{w}{m} {w}{m}" for w in words for m in marks]
    encoder = PieceEncoder(tokenizer_file())
    given, raw = [], encoder._raw
    monkeypatch.setattr(encoder, "_raw", lambda pieces: given.extend(pieces) or raw(pieces))
    got = encoder.encode(texts)
    assert len(given) <= 2 * len(words) + len(marks) and len(set(given)) == len(given)
    fresh = Tokenizer.from_file(tokenizer_file())
    assert got == [np.array(e.ids, dtype="<u4").tobytes() for e in fresh.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("at_once", [1, 200, 8 << 20])
def test_random_texts_encode_like_whole_texts(monkeypatch, at_once):
    monkeypatch.setattr(bit_packing, "BYTES_AT_ONCE", at_once)
    rng = random.Random(at_once)
    # white space of every kind, letters, digits and signs of one to four bytes, contractions, parts of the special token
    atoms = [*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u2000\u200a\u200b\u2028\u202f\u205f\u3000\ufeff\x00\x7fabzAZ059.,!?'\"#*|<>()_-/@"]
    atoms += [*"\u00e9\u00c7\u00d7\u00f7\u00df\u00ff\u00aa\u00ba\u00b2\u0149\u017f\u0180\u0430\u0400\u047f\u0480\u0482\u0301\u65e5\u3042\u0939\u093f\u0e44\u0663\u2167\u2019\u201d\U0001f600"]
    atoms += ["'s", "'t", "'ll", "  ", "   ", " the", "<|endoftext|>", "<|endof", "text|>", "12"]
    texts = ["".join(rng.choices(atoms, k=rng.randint(0, 30))) for _ in range(5000)]
    fresh = Tokenizer.from_file(tokenizer_file())
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert PieceEncoder(tokenizer_file()).encode(texts) == want


def test_large_ids_beside_a_null_stay_exact(spark):
    path = scratch_path(spark, "test-pages")
    ids = [None, 2**53 + 1, 2**53 + 2, 2**53 + 3]
    write_token_pages(rows(spark, [(i, "a b") for i in ids]), path, tokenizer_file(), 50_257, 2, partitions=1)
    assert [r["source_id"] for r in sorted(read_token_index(spark, path).collect(), key=lambda r: r["start"])] == ids


def test_token_pages_read_back(spark):
    path = scratch_path(spark, "test-pages")
    write_token_pages(rows(spark, ODD + [(9, "a b")]), path, tokenizer_file(), 50_257, 2, ids_per_page=16, partitions=3)
    got = sorted(read_token_index(spark, path).collect(), key=lambda r: r["start"])
    assert [r["source_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 5, 9]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    import zlib

    encoder = PieceEncoder.of(tokenizer_file())
    for r in (got[1], got[3], got[4], got[8]):
        text = dict(ODD + [(9, "a b")])[r["source_id"]] or ""
        raw = encoder.encode([text])[0] + b"\2\0\0\0"
        assert (r["n_tokens"], r["ids_crc32"]) == (len(raw) // 4, zlib.crc32(raw))
    empty = scratch_path(spark, "test-pages")
    write_token_pages(rows(spark, []), empty, tokenizer_file(), 50_257, 2)
    assert read_token_index(spark, empty).count() == 0


# ---- near-duplicates


def brute_components(texts, shingle, percent):
    sets = []
    for _, t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))} if ws else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * u:
                parent[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(texts):
        ids = [k for j, (k, _) in enumerate(texts) if root(j) == root(i) and k is not None]
        out.append((key, len(sets[i]), min(ids) if ids else None))
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    texts = list(ODD)
    for g in range(6):
        base = rng.choices(vocabulary, k=120)
        for k in range(8):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(120)] = f"new{g}-{k}-{rng.random()}"
            texts.append((100 + 10 * g + k, " ".join(words).upper() if k % 2 else "\n".join(words)))
    texts += [(200 + i, shared + " " + " ".join(rng.choices(vocabulary, k=80))) for i in range(20)]
    for percent in (80, 85):
        got = near_duplicates(rows(spark, texts), 3, percent).select("source_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute_components(texts, 3, percent), key=repr)
    kept = near_duplicates(rows(spark, texts), 3, 85).where("kept").count()
    assert kept >= 8


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(rows(spark, [])).count() == 0
    one = near_duplicates(rows(spark, [(7, None)])).first()
    assert (one["n_shingles"], one["component_id"], one["kept"], one["n_links"]) == (0, 7, True, 0)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[102] == got[101] == 100


# ---- chat


def test_chat_round_trip_with_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    odd = "<|turn|> \\<|end|> \\\\ <\\|body|> \n </turn>"
    data = [
        (1, 1, "assistant", [part("text", odd)], 0), (1, 0, "user", [part("text", odd), part("image", ref="a.png", w=512, h=300), part("text", "?")], 0),
        (1, 1, "assistant", [part("text", odd)], 0), (2, None, None, None, 0), (None, 3, "assis<|tant", [part("audio", ref="b.wav", s=1.5), part("document", ref="c.pdf", p=2)], 0),
    ]
    turns = spark.createDataFrame(data, T.StructType.fromDDL(f"conv_id long, turn int, role string, parts {PART_TYPE}, formatted int"))
    made = format_conversations(turns, PartCosts(patch_size=256, stride=128, tokens_per_tile=10, tokens_per_second=10, tokens_per_page=7))
    out = {r["conv_id"]: r for r in made.collect()}
    # 512 wide: origins 0, 128, 256; 300 high: 0 and 44
    assert [tuple(a) for a in out[1]["attachments"]] == [(0, 1, "image", "a.png", 60)] and out[None]["attachment_tokens"] == 15 + 14
    back = {r["conv_id"]: r for r in parse_conversations(made).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", odd + "<|image:1|>?"), ("assistant", odd), ("assistant", odd)]
    assert back[1]["loss_texts"] == [odd, odd] and [tuple(t) for t in back[2]["turns"]] == [("", "")] and back[None]["loss_texts"] == []
    assert back[None]["turns"][0]["role"] == "assis<|tant"
    assert format_conversations(turns.where("false")).count() == 0


# ---- decontamination


def brute_contamination(texts, items, n=10):
    windows = []
    for key, t in items:
        ws = words_of(t)
        windows += [(key, tuple(ws[i : i + n])) for i in range(max(1, len(ws) - n + 1))] if ws else []
    out = []
    for key, t in texts:
        ws, hit, found = words_of(t), set(), set()
        for item, w in windows:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
        out.append((key, len(ws), len(hit), sorted(str(x) for x in found)))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "a", "Zebra", "quark", "é1", "lamp", "x9"]) + rng.choice(["", "", str(rng.randrange(30))])
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 25)))) for k in range(12)] + [(50, "short ITEM"), (51, None), (52, "..."), (53, "the the the"), (50, "short ITEM")]
    texts = list(ODD) + [(100 + k, " ".join(word() for _ in range(60))) for k in range(20)]
    texts += [(200 + k, "lead in " + items[k][1].replace(" ", ", ") + "! the the the the " + items[k][1].upper()) for k in range(12)] + [(300, "a short item here")]
    benchmark = spark.createDataFrame([(k, t, "x", "x") for k, t in items], "item_id long, text string, term string, words string")
    got = find_contamination(rows(spark, texts), benchmark).collect()
    assert sorted(((r["source_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=repr) == sorted(brute_contamination(texts, items), key=repr)
    assert find_contamination(rows(spark, []), benchmark).count() == 0
    assert not any(r["contaminated"] for r in find_contamination(rows(spark, texts), benchmark.where("false")).collect())


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    near = item.replace("epsilon", "epsilon very")
    got = {r["source_id"]: r for r in find_contamination(rows(spark, [(1, near), (2, item), (3, "alpha only")]), benchmark).collect()}
    assert got[1]["near_items"] == ["1"] and not got[1]["contaminated"] and got[2]["item_ids"] == ["1"] and got[3]["near_items"] == []


def brute_near(texts, items, n=10, slop=2, share=0.8):
    """Items that some window, laid anywhere, meets with ``share`` of its terms within ``slop`` words, and none exactly."""
    exact, out = {repr((k, t)): found for (k, t), (_, _, _, found) in zip(texts, brute_contamination(texts, items, n))}, []
    for key, t in texts:
        ws, near = words_of(t), set()
        for item, body in items:
            all_words = words_of(body)
            for at in range(max(1, len(all_words) - n + 1)) if all_words else ():
                window = all_words[at : at + n]
                for s in range(-n - slop, len(ws) + slop):
                    held = sum(w in ws[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, w in enumerate(window))
                    if held >= share * len(window):
                        near.add(str(item))
        out.append((key, sorted(near - set(exact[repr((key, t))]))))
    return out


def test_proximity_matches_without_the_rarest_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    words = item.split()
    texts = [(100 + k, " ".join(w for w in words if w != words[k])) for k in range(10)]  # every word is met somewhere
    swapped = lambda *ks: " ".join(f"miss{k}" if k in ks else w for k, w in enumerate(words))
    texts += [(k, swapped(k)) for k in range(10)] + [(20, swapped(0, 9)), (21, swapped(1, 2, 6))]
    rng = random.Random(8)
    lexicon = ["the", "of", "a", "to", "in"] * 3 + [f"w{i}" for i in range(25)]
    long = " ".join(rng.choices(lexicon, k=16))
    items = [(1, item), (2, long), (3, "short item here only now"), (4, "the the of"), (5, "nowhere met alpha words stand apart of each other here too")]
    for k in range(40):
        changed = rng.choices(lexicon, k=4) + long.split() + rng.choices(lexicon, k=4)
        for _ in range(rng.randrange(6)):
            place = rng.randrange(len(changed))
            changed[place : place + rng.randrange(2)] = [rng.choice(lexicon)] * rng.randrange(3)
        texts.append((200 + k, " ".join(changed)))
    texts += [(300, "short thing here only now"), (301, "now only here item short"), (302, "only now and short item")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(rows(spark, texts), benchmark).select("source_id", "near_items").collect()
    assert sorted(map(tuple, got)) == sorted(brute_near(texts, items))
    found = dict(map(tuple, got))
    assert all(found[k] == ["1"] for k in range(10)) and found[20] == ["1"] and found[21] == []
    # the rarest word is in no text at all
    alone = find_contamination(rows(spark, [(1, swapped(5))]), benchmark.where("item_id = 1")).first()
    assert alone["near_items"] == ["1"] and not alone["contaminated"]


# ---- mixing


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 0), ("c", 5)], "batch string, batch_size long")
    got = {r["batch"]: r["target"] for r in batch_targets(sizes, (5, 2, 1)).collect()}
    assert got["a"] == 30 and got["c"] == 15 and got[None] == 0 and got["b"] == pytest.approx(1015 - 45)


def test_mix_comes_near_targets_and_repeats(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(50), "x", "x") for i in range(3000)] + [(None, "a", None, "x", "x"), (1, "z", -5, "x", "x"), (7, "b", 10, "x", "x"), (7, "b", 10, "x", "x")]
    frame = spark.createDataFrame(data, "source_id long, batch string, size int, target string, copies string")
    runs = [sorted(map(tuple, mix_batches(f, (5, 2, 1)).collect()), key=repr) for f in (frame, frame.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == len(data)
    sums = {}
    for _, batch, size, total, target, copies, taken in runs[0]:
        assert 0 <= copies <= 3 and taken == copies * size
        sums.setdefault(batch, [0, target])[0] += taken
    for taken, target in sums.values():
        assert abs(taken - target) <= 60
    assert mix_batches(frame.where("false"), (1,)).count() == 0
    # a batch at its cap, with rows of size 0: three times each, none four times
    capped = spark.createDataFrame([(i, "big", 100) for i in range(50)] + [(100 + i, "small", i % 2) for i in range(40)], "source_id long, batch string, size int")
    assert {r.copies for r in mix_batches(capped, (1, 50)).where("batch = 'small'").collect()} == {3}


# ---- repeated strings


@pytest.mark.parametrize("bound", [3, 4_000_000])
def test_suffix_order_and_prefixes(bound):
    rng = random.Random(bound)
    for case in range(120):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 6))]
        strings += strings[:1] * (case % 3)
        most = rng.choice([3, 50])
        with tempfile.TemporaryDirectory() as folder:
            sorter = ShardSorter(folder, most, bound, in_memory=bound)
            text = sorter.text_of(iter(strings), sum(len(s) + 1 for s in strings))
            blocks = list(sorter.sort(text))
        got, common = np.concatenate([p for p, _ in blocks]).tolist(), np.concatenate([c for _, c in blocks]).tolist()
        symbols = text.tolist()
        want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert got == want
        for k in range(1, len(want)):
            a, b = symbols[want[k - 1] :], symbols[want[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == min(n, most)


def brute_repeats(records, n):
    out = []
    for key, raw in records:
        mine = key if key is not None else float("inf")
        earlier = {b[i : i + n] for k, b in records for i in range(len(b) - n + 1) if k is not None and k < mine}
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in earlier:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(9)
    blob = lambda n: bytes(rng.randrange(256) for _ in range(n))
    common, other = blob(130), "übergroße Wörter ".encode() * 8
    records = [(k, blob(rng.randrange(40, 200)) + (common if k % 2 else other) + blob(rng.randrange(60))) for k in range(20)]
    records += [(30, common[:49]), (31, common[:50]), (32, common), (32, common), (32, other), (None, common), (None, b"\0" * 300), (33, b"\0" * 120), (34, b"\0" * 300), (35, b"")]
    frame = spark.createDataFrame([(k, bytearray(b), "x", "x", "x") for k, b in records], "source_id long, payload binary, rank string, spans string, anchor string")
    got = remove_repeats(frame, 50).select("source_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_repeats(records, 50), key=repr)
    text = remove_repeats(rows(spark, ODD).withColumn("payload", F.col("text")))
    assert text.count() == len(ODD) and text.where("source_id = 1").first()["n_bytes"] == 0
    assert remove_repeats(frame.where("false")).count() == 0


def test_windows_are_hashed_without_copies_of_the_words(spark):
    from sparktile.llm.quality_rules import base_columns

    rows = [(0, None), (1, "a b c d"), (2, "a b c d e"), (3, "a b c d e a b c d e x"), (4, "w " * 9)]
    counts = base_columns(spark.createDataFrame(rows, "source_id long, text string"))
    assert "arrays_zip" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {r.source_id: (r.n_words, r.n_repeat_words) for r in counts.collect()} == {0: (0, 0), 1: (4, 0), 2: (5, 0), 3: (11, 10), 4: (9, 9)}


def test_runs_do_not_depend_on_the_blocks_they_are_hashed_in(monkeypatch):
    from sparktile.llm import suffix_dedup

    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 10, 49, 50, 51, 300, 4_000, 90, 700, 65)] + [b"again " * 60] * 2
    found = []
    for block in (1, 256, 1 << 19):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        runs = []
        for raw, owner, start, first, size, anchor, mark in suffix_dedup.anchored_runs(texts, 50):
            for o, s, f, n, a, m in zip(*(v.tolist() for v in (owner, start, first, size, anchor, mark))):
                assert raw[f : f + n] == texts[o][s : s + n]
                runs.append((o, s, n, a, m))
        found.append(runs)
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_spans_of_a_shard_are_those_of_every_pair(spark):
    from sparktile.llm.suffix_dedup import earlier_strings

    rng, length = np.random.default_rng(6), 8
    runs = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (8, 9, 20, 30, 30, 41, 60)] + [b"a" * 20, b"a" * 30]
    rows = [(1, i, (i * 5) % 7, bytearray(r)) for i, r in enumerate(runs)]
    frame = spark.createDataFrame(rows, "anchor long, mark long, first long, run binary")
    got = {r.mark: [(s["from"], s["to"]) for s in r.spans] for r in earlier_strings(frame, length).collect()}
    want = {}
    for _, i, first, run in rows:
        earlier = {bytes(o[p : p + length]) for _, _, f, o in rows if f < first for p in range(len(o) - length + 1)}
        spans = []
        for p in range(len(run) - length + 1):
            if bytes(run[p : p + length]) in earlier:
                if spans and p <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], p + length)
                else:
                    spans.append((p, p + length))
        if spans:
            want[i] = spans
    assert got == want and len(want) > 3
