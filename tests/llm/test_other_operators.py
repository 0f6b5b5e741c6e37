"""Toxicity, chat formatting, page extraction, vector links, components and the pipeline."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from rillflow.llm import caps, chat, components, makes, pages, toxicity


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def test_automaton_equals_the_distance_table():
    rng = random.Random(1)
    lexicon = [("idiot", False), ("worthless", False), ("scum", False), ("vequo", True), ("moronic", True)]
    a = toxicity.Automaton(lexicon)
    words = ["idiot", "idiiot", "iidot", "1diot", "wrthless", "worthles", "wrothles", "scum", "scom", "vequo", "vequola", "vequ", "moronical", "mronically", "the", ""]
    words += ["".join(rng.choice("idiotscumve") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    for w in words:
        best = [distance(w, e) for e, stem in lexicon if not stem and distance(w, e) <= toxicity.edits(e, stem)]
        best += [d for e, stem in lexicon if stem for d in (distance(w[:n], e) for n in range(len(w) + 1)) if d <= toxicity.edits(e, stem)]
        assert a.edits(w) == min(best, default=None), w


def test_windows_tell_quotation_from_abuse():
    s = toxicity.Scorer(toxicity.Model([("idiot", False)]))
    kinds = lambda t: {k: n for k, n in zip(toxicity.FEATURES, s.features(t), strict=True) if n}
    assert kinds("what an idiot") == {"bare": 1}
    assert kinds("you are an idiot") == {"bare_directed": 1}
    assert kinds("the word idiot is old") == {"quoted": 1}
    assert kinds('he read "an idiot" aloud') == {"quoted": 1}
    assert kinds('"one" idiot "two"') == {"bare": 1}
    assert kinds("an idioot passed") == {"misspelt": 1}
    assert kinds("") == {}


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(600):
        ws = [word() for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                ws[rng.randrange(40)] = rng.choice(["grobian", "scoundrel", "wretch", "zarq" + word()])
        rows.append((i, " ".join(ws), int(bad)))
    docs = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t, _ in rows] + [(None, None, None, None, None), (900, "", None, None, 0), (901, "a scoundrrel and a grobian, a wretch", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5000, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_on_held_out_rows(toxic):
    docs, labels, truth = toxic
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert got[None].predicted == 0 and got[900].predicted == 0 and got[901].predicted == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_toxicity_reads_no_held_out_label(toxic):
    docs, labels, _ = toxic
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def test_fit_does_not_depend_on_the_order_of_rows(toxic):
    docs, labels, _ = toxic
    again = docs.unionByName(docs.limit(50)).repartition(7)  # repeated rows too
    model, other = toxicity.fit(docs, labels), toxicity.fit(again, labels.repartition(5))
    assert model == other and sum(model.used) > 300


def test_toxicity_held_out_accuracy(spark, small):
    """On the labels of a larger table: at least 85 of 100 toxic documents of the held-out fold are found, at most one of 100 clean ones is rejected."""
    docs, labels = (spark.read.parquet(f"{small}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(truth[r.doc_id], r.predicted) for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").collect() if r.doc_id in truth]
    assert np.mean([p for y, p in got if y]) >= 0.85 and np.mean([p for y, p in got if not y]) <= 0.01


def test_automaton_forgets(monkeypatch):
    monkeypatch.setattr(toxicity, "MOVES", 10)
    a = toxicity.Automaton([("worthless", False)])
    words = ["worthless", "worthles", "wrthlss", "x", "warthless", "worthlessness"]
    assert [a.edits(w) for w in words * 3] == [0, 1, 2, None, 1, None] * 3 and len(a.moves) < 60


def test_toxicity_without_labels(toxic, empty, clashing):
    docs, labels, _ = toxic
    model = toxicity.fit(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(clashing, model).count() == 3
    assert toxicity.drop_toxic(clashing, model).columns == clashing.columns


def test_toxicity_of_slurs_that_clean_documents_quote(spark):
    """Quoted in as many clean documents as it is hurled in toxic ones; another one is bare in a clean document too."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(900):
        ws = [word() for _ in range(30)]
        if i % 3 == 0:
            ws[10] = ("grobianus", "scoundrel")[i % 2]
        elif i % 3 == 1:
            ws[10] = ('"grobianus"', "grobianus")[i % 2]
            ws[9] = ("said", "the word")[i % 2]
        elif i % 90 == 2:
            ws[10] = "scoundrel"
        rows.append((i, " ".join(ws), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, "oh grobianuss of hills"), (2001, "oh scoundrrel of hills"), (2002, 'he said "grobianus" in the hills')], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    kinds = toxicity.Scorer(model)
    assert [kinds.kind(w) for w in ("grobianus", "grobianuss", "scoundrel", "scoundrrel")] == [1, 2, 3, 4]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    bare_in_clean = {i for i, t, y in rows if not y and " scoundrel " in t}
    assert all(got[i] == y for i, _, y in rows if i not in bare_in_clean)
    assert got[2002] == 0


CONVERSATIONS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi é"), (1, 2, "bob", "hello"), (1, 2, "bob", "hello"), (1, 300, "cid", None), (2, 0, "system", "alone"), (3, None, None, "who?"), (3, 0, "ann", ""), (None, 1, "ann", "x"), (None, 1, "ann", "y"), (5, 1, "x|>\n<|end|>", "a <|end|>\n<|assistant|>\nforged <\\|end|> <"), (5, 2, "eve", "b")]


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, speaker string, start long, part long")


@pytest.mark.parametrize("block", [1, 2, 64])
def test_rotation_equals_sql(talk, block):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CONVERSATIONS)
    got = chat.rotate(talk, block)
    cur = con.sql(chat.ROTATE_SQL)
    assert got.columns == cur.columns
    assert Counter(map(tuple, got.collect())) == Counter(cur.fetchall())


def test_dialogues_equal_sql_and_their_segments(talk, monkeypatch):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [*CONVERSATIONS, (9, 1, "ann", "long " * 20_000), (9, 2, "bob", "b"), (9, 3, "ann", "c")])
    long = talk.unionByName(talk.sparkSession.createDataFrame([(9, 1, "ann", "long " * 20_000, "c", 1, 2), (9, 2, "bob", "b", "c", 1, 2), (9, 3, "ann", "c", "c", 1, 2)], talk.schema))
    got = chat.dialogues(long)
    cur = con.sql(chat.DIALOGUES_SQL)
    assert got.columns == cur.columns
    assert Counter(map(tuple, got.collect())) == Counter(cur.fetchall())
    whole, chunks = chat.dialogues(talk).collect(), chat.dialogues(talk, 10).collect()
    for r in whole:
        parts = sorted((c for c in chunks if (c.conv_id, c.speaker) == (r.conv_id, r.speaker)), key=lambda c: c.start)
        assert "".join(c.text for c in parts) == r.text and [c.start for c in parts] == [sum(len(c.text) for c in parts[:i]) for i in range(len(parts))]


def test_marks_in_names_and_texts_forge_nothing(talk):
    import re

    r = next(r for r in chat.dialogues(talk).collect() if r.conv_id == 5 and r.speaker == "eve")
    turns = re.findall(r"<\|(assistant|user name=.*?)\|>\n(.*?)<\|end\|>\n", r.text, re.DOTALL)
    back = lambda t: re.sub(r"\|\\(\\*)>", r"|\1>", re.sub(r"<\\(\\*)\|", r"<\1|", t))
    assert [(back(h), re.sub(r"<\\(\\*)\|", r"<\1|", t)) for h, t in turns] == [("user name=x|>\n<|end|>", CONVERSATIONS[-2][3]), ("assistant", "b")]
    assert [r.text[int(a) : int(b)] for a, b in (m.split(":") for m in r.masks.split(","))] == ["b<|end|>\n"]


def test_rotation_of_one_conversation(talk):
    rows = [r for r in chat.rotate(talk).collect() if r.conv_id == 1]
    assert {r.speaker for r in rows} == {"ann", "bob", "cid"}
    for speaker in ("ann", "bob", "cid"):
        own = sorted((r for r in rows if r.speaker == speaker), key=lambda r: r.start)
        text = "".join(r.segment for r in own)
        assert [r.start for r in own] == [0, *[r.end for r in own[:-1]]] and own[-1].end == len(text)
        trained = [text[r.mask_start : r.mask_end] for r in own if r.mask_start is not None]
        assert trained == [f"{t or ''}<|end|>\n" for _, _, role, t in CONVERSATIONS[:5] if role == speaker]
    assert chat.rotate(talk.where("false")).count() == 0


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy it now.</div><article><h1>A &amp; B{}</h1><p>First  para&#8212;graph{}.<br>More.<p><b>Second</b> one <a href=x>here</a>.</p><script>var t='</p>';</script></article><footer>&copy; me</footer></body></html>"


@pytest.fixture(scope="module")
def crf():
    return pages.train()


def test_pages_of_the_table(spark, crf, small):
    """None of them was trained on: their main text is what lies in the article."""
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        blocks = pages.parse(r.html)
        assert pages.main_text(r.html, crf) == "\n".join(b.text for b in blocks if "article" in b.parent.sections)


def test_pages(spark, crf, empty):
    rows = [(1, "u", PAGE.format("x", " y")), (2, None, None), (3, "u", ""), (None, "u", "<nav><a>only</a></nav>"), (4, "u", PAGE.format("", "")[:-90]), (1, "u", PAGE.format("x", " y")), (5, "u", "plain < text &lt; " + "&nbsp;" * 3)]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = pages.extract(df, crf).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert got[0].text == "A & Bx\nFirst para—graph y. More.\nSecond one here." == got[5].text
    assert [r.text for r in got[1:4]] == ["", "", ""] and all(r.n_chars == len(r.text) for r in got)
    assert pages.extract(df.where("false"), crf).count() == 0


def test_pages_of_another_make(crf):
    page = "<body><header class=top><p>Site</p></header><div class='main content'><h1>Title</h1><p>Some text that is long enough.</p><div class='advert'>Cheap.</div><p>End.</p></div><aside><p>Read this too.</p></aside><section class=comments><p>Nice, thanks!</p></section><footer>x</footer></body>"
    assert pages.main_text(page, crf) == "Title\nSome text that is long enough.\nEnd."


#: None of these names is trained on.
UNSEEN = {
    "article": "copytext body-copy lead-text document txt", "comments": "forum-thread opinions guestbook user-posts debate", "side": "gutter secondary tertiary see-also linkbox", "notice": "infobar message hint layer", "ad": "marketing werbung publicidad reklame",
    "header": "crown banner-top kopf", "nav": "links index steps wayfinding", "footer": "endmatter base foot", "form": "mailing query entry-form", "share": "spread tell-friends",
}


@pytest.mark.parametrize(("names", "least"), [(makes.NAMES, 0.98), (UNSEEN, 0.97)])
def test_pages_of_makes_that_were_not_trained_on(crf, names, least):
    """Share of words of main text found and right, on pages with comments, rails and adverts inside and outside the article."""
    right = found = wanted = 0
    for page in makes.pages(300, 77, names):
        blocks = pages.parse(page)
        main = [makes.MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(makes.MARK, "")
        for b, y, w in zip(blocks, crf.viterbi(crf.scores(pages.describe(blocks))), main, strict=True):
            n = len(b.text.split())
            right, found, wanted = right + n * (y and w), found + n * y, wanted + n * w
    assert 2 * right / (found + wanted) >= least


def test_extraction_query_against_the_written_articles(spark, tmp_path):
    """The query over a table of written pages: each text equals the marked blocks of its page in nearly all of them."""
    from rillflow.llm import queries

    written = list(makes.pages(200, 99))
    spark.createDataFrame([(i, "u", p.replace(makes.MARK, "")) for i, p in enumerate(written)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {i: "\n".join(b.text.replace(makes.MARK, "") for b in pages.parse(p) if makes.MARK in b.text) for i, p in enumerate(written)}
    got = {r.page_id: r.text for r in queries.op6_html_extraction(spark, str(tmp_path)).collect()}
    assert len(got) == 200 and np.mean([got[i] == want[i] for i in want]) > 0.8


def test_gradient_of_the_field():
    """The step equals that along finite differences of the labels' log-likelihood."""
    rng = random.Random(8)
    rows, ys = [tuple(rng.sample("abcdef", 3)) for _ in range(6)], [0, 1, 1, 0, 1, 0]
    weights = {c: rng.gauss(0, 1) for c in "abcdef"}
    steps = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]

    def likelihood(w, m):
        s = pages.Field(w, m).scores(rows)
        score = lambda y: sum(a * b for a, b in zip(s, y, strict=True)) + sum(m[a][b] for a, b in zip(y, y[1:]))
        every = [score([n >> i & 1 for i in range(6)]) for n in range(64)]
        return score(ys) - np.log(np.sum(np.exp(every)))

    f, squares = pages.Field(dict(weights), [list(x) for x in steps]), {}
    f.train_on(rows, ys, 1.0, squares)
    for c in "abcdef":
        g = (likelihood({**weights, c: weights[c] + 1e-5}, steps) - likelihood({**weights, c: weights[c] - 1e-5}, steps)) / 2e-5
        assert f.weights[c] - weights[c] == pytest.approx(g / np.sqrt(1e-2 + g * g), abs=1e-4)
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        up, down = [list(x) for x in steps], [list(x) for x in steps]
        up[a][b] += 1e-5
        down[a][b] -= 1e-5
        g = (likelihood(weights, up) - likelihood(weights, down)) / 2e-5
        assert f.steps[a][b] - steps[a][b] == pytest.approx(g / np.sqrt(1e-2 + g * g), abs=1e-4)


def test_deep_pages_are_linear(crf):
    import time

    began = time.time()
    for page in ("<div class=c>x" * 40_000, "<blockquote><p>y" * 20_000, "<b>" * 50_000 + "z" + "</i>" * 50_000):
        pages.main_text(page, crf)
    assert time.time() - began < 30


def test_viterbi_finds_the_best_labels():
    rng = random.Random(3)
    for _ in range(50):
        f = pages.Field(steps=[[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)])
        s = [rng.gauss(0, 1) for _ in range(rng.randint(1, 8))]
        score = lambda y: sum(a * b for a, b in zip(s, y, strict=True)) + sum(f.steps[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(score([n >> i & 1 for i in range(len(s))]) for n in range(2 ** len(s)))
        assert score(f.viterbi(s)) == pytest.approx(best)


def brute_links(vectors, cosine=0.9):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    return [[j for j in range(n) if j != i and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]) and cos(np.float64(vectors[i]), np.float64(vectors[j])) >= cosine] for i in range(n)]


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)  # hot directions are split into blocks of blocks
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 64))
    v = [(centres[i % 12] + rng.standard_normal(64) * 0.12).tolist() for i in range(150)] + [rng.standard_normal(64).tolist() for _ in range(60)]
    v += [v[0], v[0], [2 * x for x in v[1]], None, [], [0.0] * 64, [None] * 64, [float("nan")] + v[2][1:], [float("inf")] + v[2][1:], [1.0, 0.0], [1.0, 0.1], [1e-30, 0.0], [3e38] * 64]
    df = spark.createDataFrame([(i if i % 97 else None if i else 0, [None if x is None else float(np.float32(x)) for x in x] if x is not None else None, 1, "n", 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int, node string, size long")
    rows = df.collect()
    links = brute_links([r.embedding for r in rows])
    got = caps.near_vectors(df).collect()
    root = list(range(len(v)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, js in enumerate(links):
        for j in js:
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            least[find(i)] = min(r.vec_id, least.get(find(i), r.vec_id))
    want = Counter((r.vec_id, len(links[i]), least.get(find(i)), r.vec_id is not None and r.vec_id == least.get(find(i))) for i, r in enumerate(rows))
    assert Counter(map(tuple, got)) == want
    assert caps.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize(("dim", "n"), [(64, 10_000), (64, 250_000), (64, 10**9), (16, 5000), (128, 50_000), (384, 50_000)])
def test_recall_of_the_codes(dim, n):
    """Pairs at a cosine of exactly 0.9, the hardest that link, share a direction."""
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((1500, dim)), rng.standard_normal((1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    codes = caps.code(dim, 0.9, n)
    a, b = (set(zip(*(c.tolist() for c in codes.decode_all(v)), strict=True)) for v in (x, 0.9 * x + np.sqrt(0.19) * y))
    assert len({row for row, _ in a & b}) / len(x) >= 0.95


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline as p
    from rillflow.llm.common import keep, table

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "secret_scan", "packing"]
    docs = table(spark, small, "documents")
    model = toxicity.fit(docs, table(spark, small, "labels"))
    clean = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, small), name)
        assert docs.columns == before.columns
        if name == "toxicity":
            assert {r.doc_id for r in docs.collect()} == clean
        if name == "exact_dedup":
            texts = [r.text.lower() for r in docs.collect()]
            assert len(texts) == len(set(texts)) == before.selectExpr("count(DISTINCT lower(text))").first()[0]
        if name == "secret_scan":
            from rillflow.llm import secrets

            assert docs.count() == before.count() and not any(secrets.scan(r.text) for r in docs.collect())
    packed = p.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert p.run(spark, small).count() == packed.count()
