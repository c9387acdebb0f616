"""Quality classifier, quality rules, language and toxicity: odd inputs, held-out accuracy, brute force."""

import re

import pytest
from pyspark.sql import functions as F

from sparktile.llm import toxicity as tox
from sparktile.llm.language_id import fit_language_model, identify_language
from sparktile.llm.quality_ordinal import fit_quality, grade_quality, text_measures
from sparktile.llm.quality_rules import Rule, quality_rules
from sparktile.llm.queries import QUERIES
from conftest import SF_DIR

CLASHING = "source_id long, text string, lang string, toxic int, grade int, n_words string, kept int, score string, words string, model string"


def rows(spark, texts, **columns):
    """(source_id, text) with extra columns whose names clash with the operators' own."""
    data = [(i, t, columns.get("lang", [None] * len(texts))[k], columns.get("toxic", [None] * len(texts))[k],
             columns.get("grade", [None] * len(texts))[k], "x", 7, "y", "z", "m") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(data, CLASHING)


ODD = [(1, None), (2, ""), (None, "the idiot is here"), (3, " \t\n"), (4, "x" * 200_000), (5, "a b c d e " * 3000), (5, "a b c d e " * 3000), (6, "12 34 !!")]


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    hit = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_rules_match_brute_force_on_odd_texts(spark):
    texts = ODD + [(7, "one two three four five six one two three four five\n# a\n# a\n\n"), (8, "é ü ñ|<> x\n" * 3)]
    got = quality_rules(rows(spark, texts)).select("source_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_rules(t)) for i, t in texts), key=repr)


def test_rules_table_and_empty_input(spark):
    table = [Rule("few_symbols", "symbols_per_word", None, 0.5)]
    text = "## ## ## ## ## ## ## ## ## ## a b c d"
    row = quality_rules(rows(spark, [(1, text)]), table).first()
    assert row["failed_rules"] == ["few_symbols"] and not row["kept"]
    assert quality_rules(rows(spark, [])).count() == 0
    with pytest.raises(ValueError):
        quality_rules(rows(spark, []), [Rule("x", "unknown")]).count()


def test_language_model_on_odd_texts(spark):
    known = [(i, t) for i, t in enumerate(["the cat and the dog and the house"] * 5 + ["der hund und die katze und das haus"] * 5 + [None])]
    model = fit_language_model(rows(spark, known, lang=["en"] * 5 + ["de"] * 5 + ["fr"]))
    assert model.langs == ("de", "en")
    got = identify_language(rows(spark, ODD + [(9, "The dog"), (10, "DIE KATZE")]), model).collect()
    found = {r["source_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(ODD) + 2 and found[9][0] == "en" and found[10][0] == "de"
    assert found[1] == found[2] == found[3] == found[6] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in found.values())
    # whatever stands next to a text in a batch does not change its score
    alone = identify_language(rows(spark, [(10, "DIE KATZE")]), model).first()
    assert alone["score"] == found[10][1]
    empty = fit_language_model(rows(spark, []))
    assert {r["lang_pred"] for r in identify_language(rows(spark, ODD), empty).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    found = QUERIES["op10_language_id"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    share = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.95


def test_ordinal_model_grades_in_order(spark):
    good, fair, poor = "the plain sentence goes on and says a thing", "THE LOUD SENTENCE!! goes on and says", "### *** $$$ BUY!! ||| *** ###"
    texts = [(i, [poor, fair, good][i % 3] + " " + "abcdefghij"[i % 10] * 3) for i in range(60)]
    data = rows(spark, texts, grade=[i % 3 for i in range(60)])
    model = fit_quality(data, data.select("source_id", "grade"), rows_per_grade=100)
    assert model.grades == (0, 1, 2) and model.thresholds[0] < model.thresholds[1]
    got = {r["source_id"]: r for r in grade_quality(data, model, keep_grade=1).collect()}
    means = [sum(got[i]["expected_grade"] for i in range(k, 60, 3)) / 20 for k in range(3)]
    assert means[0] < means[1] < means[2] and got[2]["kept"] and not got[0]["kept"]
    odd = grade_quality(rows(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["tail_probability"] <= 1 for r in odd)
    neutral = fit_quality(data, data.where("false").select("source_id", "grade"))
    assert all(r["kept"] for r in grade_quality(rows(spark, ODD), neutral).collect())
    assert grade_quality(rows(spark, []), model).count() == 0


@pytest.mark.parametrize("word", ["ЖЁЛТЫЙ ", "ΓΡΑΦΗ ", "ԲԱՌ ", "ẠẢẤ ", "LOUD ", "𐐀𐐁 "])
def test_upper_case_share_does_not_depend_on_length(word):
    for n in (4095, 4096, 9000):
        text = (word * n)[:n]
        assert text_measures(text)[3] == sum(map(str.isupper, text)) / n > 0.6


def test_quality_query_separates_labels(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = QUERIES["op1_quality_ordinal"](spark, SF_DIR).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p")).collect()
    share = {r["quality"]: r["p"] for r in got}
    assert share[1] > 0.95 and share[0] < 0.2


def test_grammar_scores_clauses(spark):
    matcher = tox.Matcher(tox.ToxicityModel({"idiot": 3.0}, {"schm": 3.0}))
    plain, aimed = matcher.total("an idiot thing"), matcher.total("you are an idiot")
    assert 0 < plain < aimed
    assert matcher.total("not an idiot") < plain and matcher.total("he said an idiot came") < aimed
    assert matcher.total("schmackel") > 0 and matcher.total("geschmack") == 0
    assert matcher.total("they kill the lights") == 0 < matcher.total("i will kill you")
    # a clause is scored once; the next clause on its own
    assert matcher.total("idiot. idiot.") == pytest.approx(2 * plain)
    parts = matcher.grammar
    assert parts.step((0, 0, 0, 0), "other") == ((0, 0, 0, 0), 1.0)


def test_toxicity_learns_stems_and_survives_odd_rows(spark):
    texts = [(i, f"word{i} plain talk number {i} about grobwort{chr(97 + i % 20)} things") for i in range(40)]
    texts += [(100 + i, f"word{i} plain talk number {i} about nothing") for i in range(200)]
    data = rows(spark, texts, toxic=[1] * 40 + [0] * 200)
    model = tox.fit_toxicity(data, data.select("source_id", "toxic"))
    assert any("grobwort".startswith(s) or s.startswith("grob") for s in model.stems)
    got = {r["source_id"]: r["score"] for r in tox.score_toxicity(rows(spark, ODD + [(50, "so grobworty"), (51, "so kind")]), model).collect()}
    assert got[50] > 0.5 > got[51] and got[None] > got[1] and got[1] == got[2] == got[51]
    bare = tox.fit_toxicity(data.where("false"), data.where("false").select("source_id", "toxic"))
    assert bare.stems == {} and tox.score_toxicity(rows(spark, []), bare).count() == 0


def test_long_clauses_are_read_in_whole_words():
    import random

    rng = random.Random(4)
    matcher = tox.Matcher(tox.ToxicityModel({"idiot": 3.0}, {"schm": 3.0}))
    whole = lambda text: sum(matcher.grammar.clause([matcher.classify(w) for w in tox.WORD.findall(c)]) for c in tox.CLAUSE_END.split(text.lower()))
    blank = lambda n: " " * n
    for n in range(385, 402):
        for text in (f"idiot{blank(n)}idiot", f"idiot {'x' * n} schmackel", f"idiot{blank(n)}xidiot", f"idiot{blank(n)}idiot{blank(n)}kill you", f"xidiot{blank(n)}idiot", f"idiot{blank(n - 5)}kill   you"):
            assert matcher.total(text) == pytest.approx(whole(text))
    for n in (1, 24, 150, 900):  # what a word lets others remember is counted in words, however long these are
        filler = lambda k: " ".join(["x" * n] * k)
        for k in range(8):
            for first, last in (("kill", "you"), ("you", "idiot"), ("said", "idiot"), ("not", "you idiot"), ("idiot", "you")):
                text = f"{first} {filler(k)} {last} {filler(9)}, schmackel"
                assert matcher.total(text) == pytest.approx(whole(text))
    assert matcher.total(f"kill {'x' * 150} {'y' * 150} {'z' * 150} you") == 2.0
    for _ in range(400):
        lexicon = ["idiot", "schmackel", "kill", "you", "not", "said"] + ["plain", "xidiot", "w" * 20] * rng.randrange(30)
        text = " ".join(rng.choice(lexicon) + rng.choice(["", "", "", blank(9), rng.choice(["", ". "])]) for _ in range(rng.randrange(300)))
        assert matcher.total(text) == pytest.approx(whole(text))


def test_sample_holds_one_text_of_an_id(spark):
    from sparktile.llm.hashing import labelled_sample

    data = rows(spark, [(1, f"text {k}") for k in range(500)] + [(2, "a"), (2, None), (3, "b"), (None, "c")])
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (3, None), (None, 1)], "source_id long, grade int")
    got = sorted((r["source_id"], r["grade"]) for r in labelled_sample(data.repartition(3), labels, "grade", 100).collect())
    assert got == [(1, 0), (1, 1), (2, 1)]
    first, again = (labelled_sample(data.repartition(n), labels, "grade", 100) for n in (1, 5))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_long_words_and_every_significant_entry_are_learnt(spark):
    long = "schimpf" * 9
    texts = [(i, f"{long} number {i} talk") for i in range(60)] + [(100 + i, f"plain number {i} talk") for i in range(200)]
    data = rows(spark, texts, toxic=[1] * 60 + [0] * 200)
    model = tox.fit_toxicity(data, data.select("source_id", "toxic"))
    assert any(long.startswith(s) for s in [*model.stems, *model.words]) and long in tox.word_forms(long)


def test_toxicity_ranks_held_out_rows(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    got = QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    recall, false = sum(r.predicted for r in got if r.toxic) / len(toxic), sum(r.predicted for r in got if not r.toxic) / len(clean)
    auc = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    print("held out", len(toxic), len(clean), "recall", recall, "false alarms", false, "auc", auc)
    assert recall > 0.6 and false < 0.05 and auc > 0.85


def test_language_model_equals_counting(spark):
    """Naive Bayes by dictionaries: the same posterior for each text."""
    import math

    import numpy as np

    from sparktile.llm import language_id as li

    known = [("en", "the cat, the dog"), ("en", "a house!"), ("de", "der Hund und die Katze"), ("de", "ein Haus"), ("de", "das Haus"), ("fr", "le chat é")]
    model = fit_language_model(rows(spark, list(enumerate(t for _, t in known)), lang=[x for x, _ in known]))

    def features(text):
        low = "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
        for order in li.ORDERS:
            for i in range(len(low) - 2):
                gram = low[i : i + order]
                if gram.strip():
                    yield int(li.ngram_buckets(np.array([ord(c) for c in gram], dtype="<u4"), order, li.BITS)[0])

    counts = {x: {} for x, _ in known}
    for x, text in known:
        for f in features(text):
            counts[x][f] = counts[x].get(f, 0) + 1
    for text in ["the haus", "le chien und", "katze é dog", "zzz"]:
        logit = {}
        for x, c in counts.items():
            total = sum(c.values()) + 0.1 * 2**li.BITS
            logit[x] = math.log(sum(k == x for k, _ in known) / len(known)) + sum(math.log((c.get(f, 0) + 0.1) / total) for f in features(text))
        top = max(logit, key=logit.get)
        want = 1 / sum(math.exp(v - logit[top]) for v in logit.values())
        got = identify_language(rows(spark, [(1, text)]), model).first()
        assert got["lang_pred"] == top and got["score"] == pytest.approx(want, rel=1e-3)


def test_many_classes_have_a_defined_result(spark):
    from sparktile.llm.hashing import sample_rows

    texts = [(i, f"wort{i} text") for i in range(3000)]
    data = rows(spark, texts, lang=[f"l{i % 1500}" for i in range(3000)])
    assert sample_rows(data, "lang", 1000).count() == 3000 and sample_rows(data, "lang", 1000).columns == data.columns
    model = fit_language_model(data)
    assert len(model.langs) == 1500 and float(sum(2.718281828459045**p for p in model.priors)) == pytest.approx(1.0)
    # the prior is the share of all rows, also where a language has more than are counted
    known = rows(spark, [(i, "a text of words") for i in range(400)], lang=["en"] * 300 + ["de"] * 100)
    few = fit_language_model(known, rows_per_language=50)
    assert few.langs == ("de", "en") and [round(2.718281828459045**float(p), 6) for p in few.priors] == [0.25, 0.75]


def test_toxicity_held_out_accuracy(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9
