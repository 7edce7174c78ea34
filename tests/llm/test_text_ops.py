"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline

from lathework.llm import bpe, decontam, langid, license_scan, line_dedup
from lathework.llm.components import connected_components
from lathework.llm.minhash import MinHashConfig, near_duplicates
from lathework.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, texts, **more):
    rows = [(i, t, "x", 7, 7, "y") for i, t in enumerate(texts)]
    # Columns whose names operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, rep long, words string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(60)]
    texts = [None, "", "  \n ", "one", "one", "Two words", "x" * 20000]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 4)):
            near = list(b)
            for _ in range(rng.randint(0, 8)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near).capitalize())
    family = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(80):
        near = list(family)
        for _ in range(rng.randint(0, 9)):
            near[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_all_pairs(spark, corpus, k):
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark, corpus), MinHashConfig(shingle=k, block=16)).collect()}
    sets = []
    for t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(corpus)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), find(i), find(i) == i)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = near_duplicates(rows, MinHashConfig(shingle=2)).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["3", "None", "None"] and all(r["kept"] for r in got)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 7), (None, 3), (9, 8), (8, 9), (9, 8)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 600)}, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_license_places(spark):
    texts = [None, "", "Under the MIT License. under the  mit-license", "Apache License, Version 2.0; CC BY-NC 4.0", "the mit license under", "under the mit", "This work is licensed under the GNU General Public License, version 3.", "m" * 5000]
    got = {r["doc_id"]: r for r in license_scan.summary(license_scan.license_scan(docs(spark, texts * 2))).collect()}
    for i, t in enumerate(texts * 2):
        w = words(t)
        places = [(x.label, s) for x in license_scan.BASE for s in range(len(w)) if w[s : s + len(x.key)] == x.key]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({p[0] for p in places})))
        assert (r["first_word"], r["last_word"]) == ((min(p[1] for p in places), max(p[1] for p in places)) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[6]["labels"] == "gpl-3" and got[6]["score"] == 1.0
    assert license_scan.summary(license_scan.license_scan(docs(spark, []))).count() == 0


def test_whole_notices_and_long_texts(spark):
    long = "lorem ipsum " * 100_000 + "Under the MIT license " + "dolor " * 50_000
    texts = [f"// Copyright\n * {t.notice.upper()}\n int main()" for t in license_scan.LIBRARY] + [long]
    got = {r["doc_id"]: r for r in license_scan.summary(license_scan.license_scan(docs(spark, texts))).collect()}
    for i, t in enumerate(license_scan.LIBRARY):
        assert t.label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, t
    assert (got[len(texts) - 1]["first_word"], got[len(texts) - 1]["n_words"], got[len(texts) - 1]["base_labels"]) == (200_000, 250_004, "mit")


def test_any_library_matches_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(9)]
    library = []
    for i in range(30):
        notice = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        a = rng.randrange(len(notice))
        library.append(license_scan.Template(f"t{i % 25}", " ".join(notice), " ".join(notice[a : rng.randint(a + 1, len(notice))]), i % 4 == 0))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    got = {r["doc_id"]: sorted((p["label"], p["base"], p["start"], p["score"]) for p in r["places"]) for r in license_scan.license_scan(docs(spark, texts), tuple(library)).collect()}
    some = 0
    for i, text in enumerate(texts):
        w, want = text.split(), []
        for t in library:
            for s in range(len(w) - len(t.key) + 1):
                if w[s : s + len(t.key)] == t.key:
                    same = [0 <= s - t.before + j < len(w) and w[s - t.before + j] == x for j, x in enumerate(t.words)]
                    want.append((t.label, t.base, s, sum(same) / len(same)))
        assert got[i] == sorted(want)
        some += len(want)
    assert some > 300


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    letters = "aeinrstohl éçß漢字ΣσЖж'́ \n\t01!?<|>–“\x1c"
    texts = [None, "", "<|startoftext|>Hi<|endoftext|>'s", "a" * 3000, "ha" * 2000] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["a" + chr(c) + "B" for c in range(0x80, 0x3000, 7)]
    library = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r for r in bpe.summary(bpe.bpe_encode(docs(spark, texts * 2), tokenizer_path())).collect()}
    for i, t in enumerate(texts * 2):
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert bpe.bpe_encode(docs(spark, []), tokenizer_path()).count() == 0


def test_a_small_cache_changes_nothing(monkeypatch):
    vocabulary = bpe.Vocabulary(tokenizer_path())
    texts = ["the quick brown fox jumps over the lazy dog again and again"] * 3 + ["another fox"]
    whole = bpe.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    small = bpe.Encoder(vocabulary)
    assert [small.encode([t])[0] for t in texts] == whole


def test_lines(spark):
    long = " ".join(f"word{i}" for i in range(30))
    texts = [f"head\n{long}\ntail", None, "", f"{long.upper()} ", f"a\n{long}", "a\na", f"{long}\n{long}", " \n", f"  {long}\n\n  rest\n"]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, texts).withColumn("removed_spans", F.lit(1)).withColumn("d1", F.lit("clash"))).collect()}
    assert [got[i]["text"] for i in range(9)] == [texts[0], None, "", "", "a", "a\na", "", " \n", "rest\n"]
    assert [(s["start"], s["end"]) for s in got[4]["removed_spans"]] == [(1, len(texts[4]))] and got[4]["d1"] == "clash"
    same = spark.createDataFrame([(1, long), (1, long), (1, f"x\n{long}"), (1, None), (9, long), (9, None), (None, long), (None, f"{long}\ny"), (None, "z " + long), (None, "z " + long)], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in line_dedup.line_dedup(same).collect()) == sorted([long, long, f"x\n{long}", "None", "", "None", "", "y", "z " + long, "z " + long])
    names = spark.createDataFrame([("10", long), ("9", long), (None, long)], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(names).collect()} == {"10": long, "9": "", None: ""}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def brute_units(texts, cfg):
    """The words (by number) that go from each text, by comparing all runs of units as tuples of words."""
    begins = {
        "line": lambda before, gap, word: "\n" in gap,
        "paragraph": lambda before, gap, word: gap.count("\n") > 1,
        "sentence": lambda before, gap, word: before[-1] in ".!?" or regex.match(r"\p{Lu}", word),
    }
    seen, out = {}, []
    for i, t in enumerate(texts):
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        w = [t[a:b] for a, b in places]
        runs = set()
        for unit in cfg.units:
            starts = [n for n in range(len(w)) if not n or begins[unit](w[n - 1], t[places[n - 1][1] : places[n][0]], w[n])]
            stops = [*starts[1:], len(w)]
            runs |= {(a, min(b for b in stops if b - a >= cfg.min_words)) for a in starts if len(w) - a >= cfg.min_words}
            runs |= {(max(a for a in starts if b - a >= cfg.min_words), b) for b in stops if b >= cfg.min_words}
        gone = set()
        for a, b in sorted(runs):
            doc, first = seen.setdefault(tuple(x.translate(LOWER) for x in w[a:b]), (i, b))
            if doc != i or a >= first:
                gone |= set(range(a, b))
        out.append(gone)
    return out


@pytest.mark.parametrize("units", [("line", "sentence"), ("line",), ("paragraph",), ("sentence",)])
def test_runs_of_units_match_brute_force(spark, tmp_path, units):
    rng = random.Random(len(units[0]))
    cfg = line_dedup.LineConfig(min_words=6, units=units)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ärger", "漢字", "Ab", "end.", "so!", "why?", "Über."]
    gaps = [" "] * 8 + ["\n", "\n\n", "  ", " \n \t\n", "\r\n"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))
    passages = [make(n) for n in (4, 7, 12, 30)]
    texts = [None, "", " ", "x", "ha " * 50, "Ha\n" * 50] + ["".join(rng.choice([make(rng.randint(1, 9)), rng.choice(passages), rng.choice(passages).upper()]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    texts += [texts[20], texts[21] + "\n" + texts[21]]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, texts).repartition(3), cfg).collect()}
    some = 0
    for i, gone in enumerate(brute_units(texts, cfg)):
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i] or "")]
        spans = [(s["start"], s["end"]) for s in got[i]["removed_spans"]]
        assert {n for n, (a, b) in enumerate(places) if any(s <= a and b <= e for s, e in spans)} == gone
        assert (got[i]["text"] or "").split() == [texts[i][a:b] for n, (a, b) in enumerate(places) if n not in gone]
        kept = [j for j in range(len(texts[i] or "")) if not any(s <= j < e for s, e in spans)]
        assert got[i]["text"] == (texts[i] and "".join(texts[i][j] for j in kept))
        some += len(gone)
    assert some > 100
    if units == line_dedup.LineConfig().units:  # the SQL says the same
        frame = docs(spark, [t for t in texts if t])
        frame.write.parquet(str(tmp_path / "documents.parquet"))
        want = duckdb.sql(line_dedup.summary_sql(cfg).replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
        assert sorted(want) == sorted(map(tuple, line_dedup.summary(line_dedup.line_dedup(frame, cfg)).collect()))


def test_passages_inside_lines_go_in_time(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice("aeiou") + "".join(rng.choice("rstlnm") for _ in range(5)) for _ in range(n))
    passage = " ".join(make(9).capitalize() + "." for _ in range(6))
    texts = [f"{make(30)} {passage} {make(30)}" for _ in range(20)] + [passage.replace(" ", "\n", 7).replace(" ", "  ")] + [make(400_000), f"{make(200_000)} {passage} {make(200_000)}"]
    lines = [make(25) for _ in range(8000)]
    texts.append("\n".join(lines * 2))  # each line twice in one text
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert got[23]["text"] == "\n".join(lines)
    assert got[0]["text"] == texts[0] and got[21]["text"] == texts[21] and got[20]["text"] == ""
    for i in [*range(1, 20), 22]:
        assert got[i]["text"] == texts[i].replace(passage + " ", "") and len(got[i]["removed_spans"]) == 1


def brute_hits(texts, items, k=10):
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            v = words(item)
            n = min(k, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[j : j + n]:
                        hit |= set(range(s, s + n))
                        names.add(str(name))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 12, 12, 25, 40])] + [(8, None), (9, "only!"), (10, "zz zz")]
    texts = [None, "", "Only", "zz zz zz"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    texts += [texts[9] + " " + items[6][1].upper() + " q " + items[6][1][4:], items[7][1]] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.summary(decontam.matches(docs(spark, texts), bench, decontam.DecontamConfig(block_bytes=block_bytes)))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)
    clean = decontam.decontaminated(docs(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, x in got.items() if not x[4]} and clean.columns == docs(spark, []).columns
    assert decontam.summary(decontam.matches(docs(spark, texts), bench.limit(0))).filter("contaminated").count() == 0


def test_long_texts_are_searched_whole(spark):
    item = " ".join(f"i{n}" for n in range(25))
    texts = ["x y " * 300_000 + item + " end", "x y " * 300_000]
    bench = spark.createDataFrame([(7, item), (8, "x " * 9 + "y")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.summary(decontam.matches(docs(spark, texts), bench)).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["n_items"]) == (600_026, 25, 1) and not got[1]["contaminated"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_rows_are_decontaminated_by_their_own_text(spark, block_bytes):
    bench = spark.createDataFrame([(1, "zz zz"), (2, "yy yy yy yy"), (3, "vv ww vv ww")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "a zz zz"), (None, "b"), (7, "yy yy yy yy"), (7, "clean"), (8, None)], "doc_id long, text string").withColumn("row", F.lit(1))
    got = decontam.decontaminated(rows, bench, decontam.DecontamConfig(block_bytes=block_bytes))
    assert got.columns == rows.columns and sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(None, "b"), (7, "clean"), (8, None)]))


def test_language(spark):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
    kinds = {"aa": "tha ing ou er".split(), "bb": "sch ung ei zu".split(), "cc": "ção ñe qui lla".split()}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !!", "bb"), (None, "thaing thaou", "cc"), (5, rows[5][1], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.language_id(frame, langid.LangConfig(slots_log2=14)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    pred = defaultdict(set)
    for r in got:
        pred[r["doc_id"]].add(r["lang_pred"])
    assert pred[1000] == pred[1001] == pred[1002] == {"und"} and pred[None] == {"aa"}
    assert sum(pred[i] == {k} for i, _, k in rows[:300]) >= 297
    assert {r["lang_pred"] for r in langid.language_id(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(frame.limit(0)).count() == 0


def text_grams(text, sizes):
    """n-grams by plain slicing: lower case, each run of other characters one gap, a gap at both ends."""
    flat = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    flat = re.sub(" +", " ", flat)
    return [flat[i : i + n] for n in sizes for i in range(len(flat) - n + 1)]


def test_language_scores_are_those_of_exact_sets(spark):
    rng = random.Random(14)
    kinds = {"aa": "tha ing ou er".split(), "bb": "sch ing zu er".split(), "cc": "ção ñe ou lla".split()}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) + rng.choice(["", ",", ". ", " 7"]) for _ in range(n))
    rows = [(i, make(k, rng.randint(3, 25)).title(), k) for i, k in enumerate(rng.choices(list(kinds), k=240))]
    rows += [(900, make("aa", 20) + " " + make("bb", 20), None), (901, "", None), (902, "éé qq", None), (903, make("cc", 60_000), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cfg = langid.LangConfig(slots_log2=20)
    held = {r["doc_id"] for r in frame.filter(langid.held_out(F.col("doc_id"))).collect()}
    model = langid.train(frame.filter(~langid.held_out(F.col("doc_id"))), cfg)
    known = []
    for lang in sorted(kinds):
        times = defaultdict(int)
        for i, t, k in rows:
            if k == lang and i not in held:
                for g in set(text_grams(t, cfg.sizes)):
                    times[g] += 1
        known.append({g for g, n in times.items() if n >= cfg.least_docs})
    assert model.languages == sorted(kinds) and all(0 < c < 1e-3 for c in model.chance)
    got = {r["doc_id"]: r for r in langid.language_id(frame, cfg).collect()}
    off = []
    for i, t, _ in rows:
        evidence = np.zeros(3)
        for n in cfg.sizes:
            own = text_grams(t, (n,))
            hits = np.array([sum(g in k for g in own) for k in known])
            evidence += np.maximum(0, (hits - len(own) * model.chance) / (1 - model.chance))
        assert got[i]["held_out"] == (i in held)
        if not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        else:
            assert got[i]["lang_pred"] == model.languages[evidence.argmax()]
            off.append(abs(got[i]["score"] - (evidence.max() / evidence.sum() if evidence.sum() else 0)))
    # A false positive of the filter is one hit in some hundreds of n-grams, in a few texts.
    assert max(off) < 0.05 and sum(x > 1e-3 for x in off) <= 0.05 * len(off)
    # Every n-gram a language holds is found in its bit.
    text = rows[0][1]
    for h, counts in langid.grams([text], cfg.sizes):
        masks = model.masks[langid._slot(h, 0, cfg.slots_log2), 0] & model.masks[langid._slot(h, 1, cfg.slots_log2), 0]
        n = cfg.sizes[0] if counts[0] == len(text_grams(text, cfg.sizes[:1])) else cfg.sizes[1]
        for g, mask in zip(text_grams(text, (n,)), masks.tolist()):
            assert all(mask >> i & 1 for i in range(3) if g in known[i])


def test_language_ties_and_too_many_labels(spark):
    rows = [(i, "the same words for both", "zz" if i % 2 else "aa") for i in range(40)] + [(100, "the same words", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tie = [r for r in langid.language_id(frame, langid.LangConfig(slots_log2=16)).collect() if r["doc_id"] == 100][0]
    assert tie["lang_pred"] == "aa" and tie["score"] == pytest.approx(0.5, abs=0.01)
    with pytest.raises(ValueError, match="more than 1 lang"):
        langid.language_id(frame, langid.LangConfig(most_languages=1))


def test_texts_of_no_known_language_go(spark):
    rows = [(i, f"the quick brown fox number {i}" if i % 2 else f"der schnelle braune Fuchs {i}", "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, "漢字仮名交", None), (101, None, "en"), (102, "12 !!", "en")]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(80))
