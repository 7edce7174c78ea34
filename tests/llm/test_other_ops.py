"""Operators on pages, chats and vectors against brute force, and the pipeline."""

import hashlib
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lathework.llm import chat, hnsw, html_extract, warc
from lathework.llm.common import shared_folder


@pytest.fixture(scope="module")
def potentials():
    return html_extract.train(html_extract.training_pages())


def test_marginals_are_those_of_all_labelings(potentials):
    batch = html_extract.Batch()
    batch.add('<div class=menu><a href=x>go</a></div><article><p>Some text, here.</p><div id=ad>buy</div></article>')
    trees = html_extract.Trees(batch)
    n = len(trees.parent)
    total = np.zeros(n)
    z = 0.0
    for labels in range(2**n):
        y = [(labels >> i) & 1 for i in range(n)]
        e = sum(potentials.unary[trees.features[i]].sum() for i in range(n) if y[i]) + sum(potentials.pair[trees.edge[i], y[trees.parent[i]], y[i]] for i in range(1, n))
        z += math.exp(e)
        total += math.exp(e) * np.array(y)
    assert np.allclose(html_extract.marginals(trees, potentials)[0], total / z)


def test_marginals_of_other_pages(potentials):
    pages = html_extract.training_pages(40, seed=77)
    batch = html_extract.Batch()
    for p in pages:
        batch.add(p)
    trees = html_extract.Trees(batch)
    assert ((html_extract.marginals(trees, potentials)[0] >= 0.5) == trees.label).mean() > 0.98


A = "The council met on Tuesday to discuss the bridge. Work will begin in spring, said the mayor, and end before winter."
B = "Residents had asked for a wider path; the plan now has one. It costs two million, of which the state pays half."
C = "A second vote is due in May. Until then, the old crossing stays open to walkers and riders."
#: Written by hand, in manners that the training code has none of; each page's article is A, B and C.
LAYOUTS = {
    "portal": f"""<html lang=de><body><div id="kopfbereich" class="header"><img src=x><a href="/">Zeitung</a></div>
        <div class="nav-main"><a href=1>Politik</a> | <a href=2>Sport</a> | <a href=3>Wetter</a> | <a href=4>Kultur</a></div>
        <div class="spalte"><div class="article__body" itemprop="articleBody"><p class="lead">{A}</p><p>{B}</p><p>{C}</p></div></div>
        <div class="footer-links"><a href=5>Impressum</a> <a href=6>Datenschutz</a> <a href=7>Kontakt</a></div></body></html>""",
    "blog": f"""<!doctype html><body class="single single-post"><header role="banner"><h1 class="site-title"><a href="/">My blog</a></h1></header>
        <main id="primary"><article id="post-17" class="hentry"><div class="entry-content"><p>{A}<p>{B}<p>{C}</div></article>
        <section id="comments" class="comments-area"><ol><li class="comment"><p>First! What a great read, thanks a lot.</p></li><li class="comment"><p>I do not agree. The path is wide enough.</p></li></ol></section></main>
        <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent</h2><ul><li><a href=1>One post</a><li><a href=2>Two posts</a></ul></section></aside></body>""",
    "tables": f"""<BODY><TABLE width=100%><TR><TD colspan=2><A HREF=a>Home</A> <A HREF=b>News</A> <A HREF=c>Links</A></TD></TR>
        <TR><TD width=20%><A HREF=d>Archive</A><BR><A HREF=e>Guestbook</A><BR><A HREF=f>Webring</A></TD><TD><P>{A}<P>{B}<P>{C}</TD></TR></TABLE></BODY>""",
    "app": f"""<body><div id="root"><div class="css-1x2y3z"><div role="navigation"><ul><li><a href=1>Feed</a></li><li><a href=2>Explore</a></li><li><a href=3>Saved</a></li></ul></div>
        <div class="css-9q8w7e"><div class="css-0a"><p>{A}</p><p>{B}</p><p>{C}</p></div></div><div class="cookie-consent"><p>We use cookies to improve your experience.</p><button>OK</button></div></div></div></body>""",
    "docs": f"""<body><nav class="toc"><ul><li><a href=#1>Intro</a></li><li><a href=#2>Usage</a></li></ul></nav><main role="main"><section><p>{A}</p><p>{B}</p><p>{C}</p></section></main>
        <footer><p>Built with a static site generator.</p></footer></body>""",
    "shop": f"""<body><div class="promo-banner">Free shipping on all orders this week!</div><div class="container"><div class="row"><div class="col-md-8"><div class="story"><p>{A}</p><p>{B}</p>
        <div class="advert"><p>Buy a bridge today, only at our store.</p></div><p>{C}</p></div></div><div class="col-md-4 sidebar"><h3>Related</h3><a href=1>Tunnels</a><a href=2>Ferries</a></div></div></div></body>""",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_not_trained_on(potentials, name):
    assert html_extract.main_texts([LAYOUTS[name]], potentials) == [" ".join((A, B, C))]


def test_hostile_pages_take_linear_time(potentials):
    n = 1 << 20
    for piece in ('<a "', "<!", "<div>", "<a", "<a x=\"'", "<!--", "<script>", "<a '\">", "<", "a<b>", "<p><div><b>", "</x><div>", '<a "">' * 9 + '<a ">'):
        began = time.time()
        texts = html_extract.main_texts([piece * (n // len(piece)), "<p>" + A], potentials)
        assert time.time() - began < 20 and texts[1] in ("", A)
    assert html_extract.main_texts(["<SCRIPT>İİ</p></Script><article><p>" + A], potentials) == [A]


def test_pages(spark, potentials):
    article = "<article><h1>Head&amp;line</h1><p><b>One&nbsp;two<br>three<p>Fo<i>ur</i>\n five &lt;tag&gt; &#233;</article>"
    rows = [
        (1, "u", f"<!DOCTYPE html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>menu</a></ul></nav><!-- <p>no --><div class='ad'>Buy this now</div>{article}<footer>&copy; me</footer>"),
        (2, None, None), (3, "u", ""), (4, "u", "<div><<p"), (None, "u", "<" * 500), (6, "u", "<div>" * 3000 + "deep"), (1, "u", f"<body>{article}"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_main_text(frame, potentials).collect()
    assert len(got) == len(rows)
    want = "Head&line One two three Four five <tag> é"
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert html_extract.extract_main_text(frame.limit(0), potentials).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(6)
    texts = ["", None, "a <turn x> </turn>\n b\\l \\b", chat.PLANTED, "w " * 900, "ein paar <Wörter> \n mehr"]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 30)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", None, "ro>le\n<"]) if t or c % 3 else "system", rng.choice(texts) if rng.random() < 0.4 else "hm " * rng.randint(0, 90)))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1)).withColumn("p", F.lit("x"))
    windows = chat.chat_windows(frame)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tokens = F.aggregate(chat.read_turns("text"), F.lit(0), lambda s, t: s + F.regexp_count(t["text"], F.lit(r"[^\x20\x09-\x0D]+")) + chat.MARK_TOKENS)
    sizes = windows.select(tokens.alias("n"), F.size(chat.read_turns("text")).alias("turns"), "n_repeated").collect()
    assert all(r["n"] <= 512 + 128 or r["turns"] - r["n_repeated"] == 1 for r in sizes)
    assert chat.read_back(chat.chat_windows(frame.limit(0))).count() == 0


def test_near_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    rows = []
    for i in range(700):
        v = base[rng.integers(300)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 0), (1004, rows[0][1], None), (1005, [1.0, 2.0], 1), (None, rows[0][1], 0), (1006, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x"))
    got = {r["vec_id"]: r for r in hnsw.embedding_near_duplicates(frame, hnsw.HnswConfig(shard_rows=120)).collect()}
    good = [r for r in rows if r[0] is not None and (r[0] < 1000 or r[0] == 1005) and r[2] is not None and len(r[1]) == 16]
    v = np.array([r[1] for r in good])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    links = (v @ v.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    component = np.arange(len(good))
    for _ in range(len(good)):
        least = np.minimum(component, np.where(links, component[None], len(good)).min(axis=1))
        if (least == component).all():
            break
        component = least
    assert links.sum() > 500 and len(set(component.tolist())) < len(good)
    for k, r in enumerate(good):
        g = got[r[0]]
        assert (g["n_links"], g["component_id"], g["kept"]) == (links[k].sum(), good[component[k]][0], component[k] == k) and g["recall"] >= 0.99
    for r in rows:
        if r[0] is None or r[0] >= 1000:
            assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (0, r[0], True)
    assert hnsw.embedding_near_duplicates(frame.limit(0)).count() == 0


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 2.0], 0), (1, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], None)]
    got = hnsw.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert [x for x in found if x[0] in (2, 4)] == [(2, 3, 1, False), (4, 0, 4, True), (4, 0, 4, True)] and all(x[2] == 1 for x in found if x[0] < 4)


def test_a_dense_group_gives_a_forest():
    rng = np.random.default_rng(3)
    v = np.ones((900, 16)) + rng.normal(size=(900, 16)) * 0.03
    v[700:] = rng.normal(size=(200, 16))
    cfg = hnsw.HnswConfig()
    shard = hnsw.Shard.read(hnsw._pack(np.arange(900), np.ones(900, np.int64), v, hnsw.Graph(hnsw._unit(v).astype(np.float32), 12, 48)), cfg)
    links, audit = hnsw.links_between(shard, shard, cfg)
    unit = hnsw._unit(v)
    want = unit @ unit.T >= cfg.threshold
    np.fill_diagonal(want, False)
    assert (links == want).all() and want.sum() > 400_000 and audit.total > 0 and audit.hit >= 0.995 * audit.total
    edges = hnsw.forest(links)
    assert all(links[i, j] for i, j in edges) and len(edges) < 2 * 900
    root = list(range(900))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in edges:
        root[find(i)] = find(j)
    assert len({find(i) for i in range(700)}) == 1


def test_graph_recall():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph(v, 12, 48)
    q = rng.normal(size=(100, 24)).astype(np.float32)
    exact = np.argsort(-(q @ v.T), axis=1)[:, :10]
    hit = sum(len({i for _, i in graph.search(x, 96)[:10]} & set(e.tolist())) for x, e in zip(q, exact))
    assert hit >= 900


@pytest.mark.parametrize("cut", [slice(0, 300), slice(250, 256)])
def test_links_of_a_graph_that_falls_apart(cut):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(150, 8)), 2, axis=0) + rng.normal(size=(300, 8)) * 0.01
    cfg = hnsw.HnswConfig()
    graph = hnsw.Graph(hnsw._unit(v).astype(np.float32), 12, 48)
    gone = np.arange(300)[cut]
    for layer in graph.layers:  # no link leads to or from these
        layer[np.isin(layer, gone)] = -1
        layer[gone] = -1
    read = lambda ids: hnsw.Shard.read(hnsw._pack(ids, np.ones(300, np.int64), v, graph), cfg)
    shard, other = read(np.arange(300)), read(np.arange(300, 600))
    unit = hnsw._unit(v)
    near = unit @ unit.T >= cfg.threshold
    assert (hnsw.links_between(shard, other, cfg)[0] == near).all()
    np.fill_diagonal(near, False)
    assert (hnsw.links_between(shard, shard, cfg)[0] == near).all()


def test_warc_round_trip(spark):
    big, small = "<p>é</p>" * 300, "tiny"
    rows = [(1, "http://a/ 1", big), (2, "http://b", big), (3, None, small), (4, "x", small), (5, "x", None), (6, "y", ""), (7, "z", big), (7, "z", big), (None, "n", "x" * 2000), (9, "q", "x" * 2000), (10, "r", "\r\n\r\n" * 400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    cfg = warc.WarcConfig(archive_bytes=400, read_bytes=300, gap=100)
    index = warc.write_archives(frame, cfg)
    got = warc.read_records(index, cfg).collect()
    assert len(got) == len(rows)
    for r in got:
        url, html = next((u, h) for p, u, h in rows if p == r["page_id"])
        data = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == data
        assert r["url"] == "".join((url or "").split())
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds >= {(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (3, "response", None), (4, "response", None), (9, "response", None), (5, "response", None)}
    assert warc.read_records(index, cfg).rdd.getNumPartitions() > 3  # tasks follow the bytes
    headers, body = warc.parse(warc.record(3, "u", b"<p>", None, False, cfg))
    assert headers["Content-Type"] == "application/http; msgtype=response" and body == b"<p>"
    one = warc.read_records(index.filter("page_id = 10"), cfg).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == ("\r\n\r\n" * 400).encode()
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    from lathework.llm.queries import tokenizer_path

    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choice(("tha", "ing", "ou", "er", "lo")) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage, item = make(60), make(20)
    texts = {i: make(80) for i in range(1, 30)}
    texts[30], texts[31] = texts[3], texts[4] + " more"  # copies
    texts[32], texts[33] = f"{make(50)}\n{passage}\n{make(40)}", f"{make(50)}\n{passage}"  # a repeated passage
    texts[34] = make(30) + " " + item + " " + make(30)
    texts[35], texts[36] = None, "123 ..."
    texts[37] = make(30_000)  # a long text
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    alone = make(70)
    rows += [(5, texts[5], "en", "s", 0), (None, alone, None, None, None), (None, alone, "en", "s", 0), (None, texts[6], "en", "s", 0), (None, None, None, None, None), (3, make(90), "en", "s", 0), (30, make(75), "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "kept": F.lit("x"), "__sum": F.lit(2.0)})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    rows_got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left_over = set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before
    assert sorted(x.split("-")[1] for x in left_over) == sorted(name for name, _ in corpus_pipeline.STAGES)
    # Of the two rows with id 3, and with id 30, each is judged by its own text; of the three without an id and with two texts, one of each text stays,
    # and the one that repeats document 6 loses its lines to it.
    assert sorted(str(r["doc_id"]) for r in rows_got) == sorted(map(str, [*range(1, 30), 3, 30, 32, 33, 37, None, None]))
    got = {r["doc_id"]: r for r in rows_got if r["doc_id"] not in (None, 3, 30)}
    library = Tokenizer.from_file(tokenizer_path())
    assert sorted(r["ids"] for r in rows_got if r["doc_id"] is None) == [[], library.encode(alone, add_special_tokens=False).ids]
    for i, r in got.items():
        left = texts[33].split("\n")[0] if i == 33 else texts[i]
        assert r["ids"] == library.encode(left, add_special_tokens=False).ids and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns and docs.dtypes == frame.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
