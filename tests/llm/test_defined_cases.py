"""Defined results of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarack.llm import conversations as C
from tamarack.llm import language as L
from tamarack.llm import mixing as M
from tamarack.llm import neighbours as N
from tamarack.llm import pages as B
from tamarack.llm import pairs as P
from tamarack.llm import personal as D
from tamarack.llm import repeated_lines as R
from tamarack.llm import sites as H
from tamarack.llm import splitting as S
from tamarack.llm import tokenize as K

T0 = datetime(2025, 1, 1, 12)


# --- tokenizer -------------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(spark):
    import random

    random.seed(3)
    texts = [None, "", " ", "a", "Привет, мир! don't", "日本語" * 900, "x" * 9000, "<|endoftext|> text", "é" * 50, "퟿\U0001f600", "a  b\n\n\n c\t", "long " * 4000, "same", "same"]
    texts += ["".join(random.choice("ab12!\n яЯ'sd日 ") for _ in range(random.randint(1, 400))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    enc = K.encoding(K.tokenizer_path())
    for r in K.encode_corpus(df).collect():
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
    for r in K.count_tokens(df).collect():
        assert r["n_tokens"] == len(enc.encode_ordinary(texts[r["doc_id"]] or ""))
    assert K.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("hard", [48, 300])
def test_joins_of_unsafe_cuts_are_repaired(hard):
    import random

    random.seed(hard)
    own = K.ChunkEncoder(K.tokenizer_path(), 1, hard)
    whole = K.encoding(K.tokenizer_path()).encode_ordinary
    texts = ["".join(random.choice("ab1!\n я'sд日") for _ in range(500)) for _ in range(60)] + ["don't" * 200, "абв" * 400]
    offsets, ids = own.batch(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole(t)


def test_chunks_are_reused():
    own = K.ChunkEncoder(K.tokenizer_path())
    text = "the admission letter arrives by post after about twenty weeks of waiting " * 30
    own.batch(pa.array([text] * 50))
    assert own.encoded < own.met / 20


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_rates_meet_shares_or_caps():
    sizes, targets = {"a": 100, "b": 1000, "c": 0}, {"a": (1.0, 2), "b": (1.0, 1), "c": (5.0, 1), "d": (0.0, 1)}
    assert M.rates(sizes, targets) == {"a": 2.0, "b": 0.2}
    big = M.rates(sizes, targets, 1000)
    assert big["a"] == 2.0 and abs(big["b"] - 0.8) < 1e-9
    assert M.rates({}, targets) == {}
    for rate, cap in ((0.3, 1), (1.7, 2), (2.5, 5), (0.01, 4), (800.0, 1000), (1200.0, 1500), (999.9, 1000), (5000.0, 20_000)):
        cdf = M.cut_cdf(rate, cap)
        assert abs(sum(1 - p for p in cdf) - rate) < 1e-6 * max(1, rate)
        drawn = np.searchsorted(cdf, (np.arange(20_000) + 0.5) / 20_000).mean()
        assert abs(drawn - rate) < 0.01 * max(1, rate)


def test_mixture(spark):
    docs = [(i, f"some words of document {i}", "abc"[i % 3], 5) for i in range(3000)] + [(9000, None, "a", 1), (9001, "", "a", 1), (9002, "text", None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 2.0, 2), ("b", 1.0, 2), ("c", None, 3), ("none", 1.0, 1), (None, 1.0, 1), ("d", 0.0, None)], "source string, weight double, max_repeats int")
    sizes = M.token_sizes(df)
    plan = M.plan(sizes, targets)
    rows = M.mix(df, plan).collect()
    few = M.of_targets(df, targets)  # counting only what has a target changes nothing
    assert sorted(map(tuple, M.mix(few, M.plan(M.token_sizes(few), targets)).collect())) == sorted(map(tuple, rows))
    counts = {}
    for r in rows:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        assert r["copy_no"] < 2
    assert max(counts.values()) <= 2 and not {9000, 9001, 9002} & set(counts)
    report = {r["source"]: r for r in M.report(sizes, plan).collect()}
    assert abs(report["a"]["actual_share"] - 2 / 3) < 0.01 and report["c"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert M.mix(df, M.plan(sizes, targets.limit(0))).count() == 0
    assert M.mix(df.limit(0), M.plan(sizes.limit(0), targets)).count() == 0


# --- sites and repeated lines ------------------------------------------------------------------------------------------


def test_hosts(spark):
    given = {"https://www.Site.example:80/a?b": "site.example", " HTTP://a.b/ | http://c.d": "a.b", "site.example/x": "site.example", "": None, None: None, "//h.example/x": "h.example", "user@h.example/x": "h.example"}
    df = spark.createDataFrame([(u,) for u in given], "u string").select("u", H.host(F.col("u")).alias("h"))
    assert {r["u"]: r["h"] for r in df.collect()} == given


def test_repeated_lines(spark):
    rows = [(i, f"Unique text {'abcdefghijkl'[i % 12]}{'qwertyuiop'[i // 12]}\nShare this page {i}\n\n123", "s1", 1) for i in range(20)]
    rows += [(i, "Share  THIS, page!", "s1", 1) for i in range(3)]  # copies of ids count once
    rows += [(100 + i, "Few", "s2", 1) for i in range(4)] + [(200, None, "s1", 1), (201, "", "s1", 1), (202, "Share this page", None, 1)]
    df = spark.createDataFrame(rows, "id long, content string, site string, cluster int")
    got = {(r["id"], r["line_no"]) for r in R.repeated_lines(df).select("id", "line_no").collect()}
    assert got == {(i, 1) for i in range(20)} | {(i, 0) for i in range(3)}
    assert {(r["id"], r["line_no"]) for r in R.repeated_lines(df, broadcast_rows=0).select("id", "line_no").collect()} == got
    assert {(r["id"], r["line_no"]) for r in R.repeated_lines(df, by="clusters").select("id", "line_no").collect()} == {(i, 1) for i in range(20)} | {(i, 0) for i in range(3)}
    assert R.repeated_lines(df.limit(0)).count() == 0
    clean = R.without_repeated_lines(df, R.repeated_lines(df))
    assert clean.count() == len(rows) and clean.where("id = 5").first()["cleaned"] == "Unique text fq\n\n123"


def test_copies_of_one_text_make_no_boilerplate(spark):
    article = "Rooms in the hall are given by lot\nBring a passport\nPublished 0{}.03.2024"
    rows = [(i, article.format(1 + i % 5), "s") for i in range(40)]  # republished under five dates: one cluster
    words = "ash birch cedar elm fir hazel larch maple oak pine".split()
    rows += [(100 + i, f"About {w} trees\nShare with friends\nChanged on 1{i}.04.2024", "s") for i, w in enumerate(words)]
    rows += [(200 + i, f"About {w} wood\nShare with friends", "t") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "id long, content string, site string")
    plain = R.repeated_lines(df.where("site = 's'")).select("id", "line_no", "n_rows", "n_clusters", "n_dates")
    assert {(r["n_rows"], r["n_clusters"], r["n_dates"]) for r in plain.where("id = 0").collect()} == {(40, 1, 5)}
    assert plain.where("id >= 100 and line_no = 1").count() == 10
    got = {(r["id"], r["line_no"]) for r in R.repeated_lines(df, by="clusters").collect()}
    assert got == {(100 + i, line) for i in range(10) for line in (1, 2)} | {(200 + i, 1) for i in range(10)}
    assert R.repeated_lines(df.limit(0), by="clusters").count() == 0


# --- conversations -----------------------------------------------------------------------------------------------------


def talk(spark, rows):
    full = [(f"{i:03d}" if r[0] is None else r[0], r[1], r[2], r[3], r[4], T0, "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id string, tg_id long, role string, content string, created_at timestamp, loaded_at timestamp, block string")


def test_reasons(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [
        (None, 1, " User", "hi", at(0)), (None, 1, "BOT", "hello", at(0)), (None, 1, "user", "more", at(40)),  # kept, then missing reply
        (None, 2, "bot", "first", at(0)), (None, 2, "user", "x", at(1)), (None, 2, "ai", "y", at(2)),  # broken
        (None, 3, "user", "​", at(0)), (None, 3, "system", "s", at(1)),  # empty
        (None, 4, "user", "q", at(0)), (None, 4, None, "who", at(1)), (None, 4, "model", "a", at(2)),  # broken
        (None, 5, "human", "q", at(0)), (None, 5, "assistant", None, at(29)), (None, 5, "assistant", "a", at(58)),  # a blank bot row
        (None, 6, "usr", "q", at(55)), (None, 6, "bot", "a", at(65)),  # over the edge of a block: one conversation
        (None, None, "user", "q", at(0)), (None, 7, "user", "q", None),
        ("003", 2, "bot", "first", at(0)),  # sent twice
    ]
    df = talk(spark, rows)
    got = {(r["account"], r["first_id"], r["reason"]) for r in C.to_drop(df).collect()}
    assert got == {(1, "002", "missing_reply"), (2, "003", "broken"), (3, "006", "empty"), (4, "008", "broken"), (5, "011", "missing_reply")}
    kept = C.conversations(df).orderBy("account", "block", "seg", "pos").collect()
    assert [(r["account"], r["speaker"], r["content"]) for r in kept] == [(1, "user", "hi"), (1, "assistant", "hello"), (6, "user", "q"), (6, "assistant", "a")]
    assert C.to_drop(df.limit(0)).count() == 0


def test_kahn_and_cycles(spark):
    assert C.kahn([3, 1, 2], [(0, 1)]) == ([2, 0, 1], [])
    assert C.kahn([1, 2, 3], [(0, 1), (1, 0)]) == ([2], [0, 1])
    df = spark.createDataFrame([("a", 1, "user", "q", T0, T0, "b"), ("b", 1, "bot", "r", T0 + timedelta(minutes=1), T0, "a")], "id string, tg_id long, role string, content string, created_at timestamp, loaded_at timestamp, parent string")
    assert [r["reason"] for r in C.to_drop(df, reply_to="parent").collect()] == ["broken"]


def replies(spark, rows):
    """Rows (id, role, minutes, reply_to) of one account."""
    full = [(i, 1, r, "x", T0 + timedelta(minutes=m), T0, p) for i, r, m, p in rows]
    return spark.createDataFrame(full, "id string, tg_id long, role string, content string, created_at timestamp, loaded_at timestamp, parent string")


def test_edges_against_time_reach_over_blocks(spark):
    cycle = [("a", "user", 50, "b"), ("b", "bot", 70, None)]  # b replies to a, and says a replies to b
    assert [r["reason"] for r in C.to_drop(replies(spark, cycle), reply_to="parent").collect()] == ["broken"]
    # an answer stamped before its question: put behind it, over the edge of an hour
    swapped = replies(spark, [("q0", "user", 40, None), ("early", "bot", 55, "q1"), ("q1", "user", 65, "q0"), ("late", "bot", 66, None)])
    turns = C.conversations(swapped, reply_to="parent").orderBy("block", "seg", "pos").collect()
    assert [r["id"] for r in turns] == ["q0", "q1", "early", "late"]
    assert C.to_drop(swapped, reply_to="parent").count() == 0
    # replies to rows of other conversations, of no account and to themselves have no edge
    loose = replies(spark, [("a", "user", 0, "c"), ("b", "bot", 1, "b"), ("c", "user", 120, "none"), ("d", "bot", 121, None)])
    assert C.to_drop(loose, reply_to="parent").count() == 0
    # a reply that stands more than a day before its target, in one conversation without a gap
    long = [(f"m{i:04d}", "user" if i % 2 == 0 else "bot", i * 20, None) for i in range(100)]
    long[1] = ("m0001", "bot", 20, "m0090")
    assert [r["reason"] for r in C.to_drop(replies(spark, long), reply_to="parent").collect()] == ["broken"]


def test_blocks_do_not_change_the_result_with_replies(spark):
    import random

    random.seed(7)
    rows, m = [], 0
    for i in range(300):
        m += random.choice([0, 1, 5, 20, 29, 40])
        rows.append((f"{i:03d}", random.choice(["user", "bot"]), m, f"{min(299, max(0, i + random.choice([-3, -1, 2, 4]))):03d}" if random.random() < 0.1 else None))
    df = replies(spark, rows)
    found = [sorted(map(tuple, C.to_drop(df, reply_to="parent", block_seconds=b).collect())) for b in (1800, 3600, 86_400, 10**7)]
    assert found[0] == found[1] == found[2] == found[3] and any(r[2] == "broken" for r in found[0])
    turns = [[r["id"] for r in C.conversations(df, reply_to="parent", block_seconds=b).orderBy("block", "seg", "pos").collect()] for b in (1800, 10**7)]
    assert turns[0] == turns[1]


def test_an_id_sent_again_with_another_time_counts_once(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("a", 1, "user", "q", at(0), at(0)), ("b", 1, "bot", "r", at(1), at(1)), ("a", 1, "user", "other", at(120), at(200)), ("a", 2, "user", "third", at(0), at(300))]
    df = spark.createDataFrame(rows, "id string, tg_id long, role string, content string, created_at timestamp, loaded_at timestamp")
    assert C.to_drop(df).count() == 0
    assert [(r["id"], r["content"]) for r in C.conversations(df).orderBy("block", "seg", "pos").collect()] == [("a", "q"), ("b", "r")]


def test_blocks_do_not_change_the_result(spark):
    import random

    random.seed(1)
    rows, t = [], T0
    for i in range(400):
        t += timedelta(minutes=random.choice([0, 1, 5, 29, 31, 90]))
        rows.append((None, 1 + i % 2, random.choice(["user", "bot", "tool", None]), random.choice(["x", "", None]), t))
    df = talk(spark, rows)
    one = sorted(map(tuple, C.to_drop(df).collect()))
    assert one == sorted(map(tuple, C.to_drop(df, block_seconds=86400).collect())) and one


# --- pairs ---------------------------------------------------------------------------------------------------------------

PAIRS = {
    "e1": ("Где?", None, "empty"), "e2": ("Где?", " ​", "empty"), "e3": ("Где?", "<p></p>", "empty"), "e4": ("Где?", '{"answer": ""}', "empty"), "e5": ("Где?", "N/A", "empty"), "e6": ("Где?", "…", "empty"),
    "c1": ("Нужно ли переводить аттестат до апостиля?", "нужно ли переводить аттестат до апостиля", "copy"), "c2": ("Is level B2 enough for the university?", "You asked: Is level B2 enough for the university?", "copy"),
    "r1": ("Где?", "Извините, я не могу ответить на этот вопрос.", "refusal"), "r2": ("Where is it?", "I'm sorry, but I can't answer that question.", "refusal"), "r3": ("Wo ist es?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
    "w1": ("Сколько денег показать на счету на год?", "Students may work up to twenty hours a week, and the employer applies for the permit.", "wrong_language"),
    "w2": ("Сколько стоит семестр? Ответьте, пожалуйста, по-английски.", "Students may work up to twenty hours a week, and the employer applies for the permit.", None),
    "t1": ("Где?", "Документы переводит переводчик, а", "truncated"), "t2": ("Где?", "Список (паспорт, аттестат", "truncated"), "t3": ("Где?", "<b>Документы переводит переводчик.", "truncated"), "t4": ("Где?", "Нужны документы: 1) паспорт; 2) ", "truncated"),
    "ok1": ("Где?", "Документы переводит переводчик.", None), "ok2": ("Где?", "Не могу не отметить, что срок строгий. Документы переводит переводчик, а апостиль ставят заранее.", None), "ok3": (None, "Документы переводит переводчик.", None),
}


def test_defects(spark):
    rows = [(k, q, a, None, "z") for k, (q, a, _) in PAIRS.items()] + [("ok1", *PAIRS["ok1"][:2], None, "z"), ("long", "Где?", "Документы переводит переводчик. " * 3000, 1, "z")]
    df = spark.createDataFrame(rows, "id string, question string, answer string, rating int, defects string")
    got = {r["id"]: r["defect"] for r in P.broken(df).collect()}
    assert got == {k: d for k, (_, _, d) in PAIRS.items() if d}
    assert P.broken(df.limit(0)).count() == 0


def test_abrupt_endings_follow_the_corpus(spark):
    full = "Страховка для студентов оформляется после прописки в городе."
    rows = [(f"f{i}", "q", full) for i in range(30)] + [("cut", "q", "Страховка для студентов оформляется после проп"), ("stop", "q", full[:-1]), ("mid", "q", "Страховка для студентов оформляется")]
    got = {r["id"] for r in P.broken(spark.createDataFrame(rows, "id string, question string, answer string")).where("defect = 'truncated'").collect()}
    assert got == {"cut", "mid"}


# --- neighbours ----------------------------------------------------------------------------------------------------------


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        c = np.round(x @ x[i], 9)
        order = [j for j in np.lexsort((ids, -c)) if j != i][:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if c[j] >= least}
    return out


def test_pairs_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.25 * rng.normal(size=(40, 16)) for c in centres] + [rng.normal(size=(60, 16))]).astype(np.float32)
    ids = np.arange(len(x)) * 3 + 1
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, x)]
    bad = [(10_000, None, "x"), (10_001, [], "x"), (10_002, [0.0] * 16, "x"), (10_003, [float("nan")] * 16, "x"), (10_004, [1.0] * 15, "x"), (10_005, [float("inf")] + [1.0] * 15, "x")]
    df = spark.createDataFrame(rows + rows[:9] + bad, "id long, embedding array<float>, cell string")
    got = {tuple(r) for r in N.similar_pairs(df, dim=16, cell=64, probes=6, max_angle=40).collect()}
    true = brute(ids, x.astype(np.float64), 10, 0.9)
    assert len(got & true) / len(true) >= 0.99 and len(got & true) / len(got) >= 0.99
    assert N.similar_pairs(df.limit(0), dim=16).count() == 0
    assert N.similar_pairs(df.limit(1), dim=16).count() == 0


def test_recall_with_default_probes_over_many_cells(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([c + rng.normal(scale=0.35, size=(50, 64)) for c in centres]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    true = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-c[i])[:10]}
    # one level, two levels, and cells dealt out over a grid of small blocks
    for options in ({}, {"sample": 400, "coarse": 12}, {"block": 40}):
        got = {(r["id"], r["other"]) for r in N.nearest(df, cell=48, **options).collect()}
        assert len(got & true) / len(true) >= 0.9, options


def test_near_equal_vectors_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    x = (np.ones(64) + 1e-3 * rng.normal(size=(700, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    got = {tuple(r) for r in N.similar_pairs(df, block=50).collect()}
    assert got == brute(np.arange(700), x.astype(np.float64), 10, 0.9)


def test_equal_vectors_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=16).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v) for i in range(60)], "id long, embedding array<float>")
    got = {tuple(r) for r in N.similar_pairs(df, dim=16).collect()}
    assert got == {(a, b) for b in range(60) for a in range(10) if a < b} | {(a, 10) for a in range(10)}
    assert got == {tuple(r) for r in N.similar_pairs(df, dim=16, block=7).collect()}


def test_anisotropic_codes_keep_inner_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = N.Quantiser(32, subspaces=16).fit(x, x)
    plain = N.Quantiser(32, subspaces=16, parallel=1.0).fit(x, x)
    along = lambda z: np.abs(((x - z.decode(z.codes(x, x))) * x).sum(axis=1)).mean()
    assert along(q) < along(plain)
    codes = q.codes(x, x)
    assert (N.unpack(N.pack(codes)) == codes).all()


# --- pages ---------------------------------------------------------------------------------------------------------------


def test_pages(spark):
    page = "Home | Study | Admission | Contact uni-test\n\n# Documents for the programme\n\nThe letter arrives by post after about ten weeks, and the fee is due at once.\n- two photos\n\nMore topics on uni-test\n→ Video: a day at the university, 4 minutes\n© 2026 uni-test. All rights reserved."
    df = spark.createDataFrame([(1, page, "uni-test.example", 1), (1, page, "uni-test.example", 1), (2, None, None, 1), (3, "", None, 1), (4, page, None, 1), (5, page.replace("The letter", "word " * 50_000 + "The letter"), None, 1)], "id long, content string, site string, line_no int")
    got = {}
    for r in B.boilerplate_lines(df).collect():
        got.setdefault(r["id"], set()).add(r["line_no"])
    assert got[1] == got[4] == {0, 7, 8, 9} and got[5] == got[1] and 2 not in got and 3 not in got
    main = {r["id"]: r["main"] for r in B.main_body(df).collect()}
    assert main[1].startswith("# Documents") and main[1].endswith("- two photos") and main[2] is None and main[3] == ""
    assert B.boilerplate_lines(df.limit(0)).count() == 0


def test_tree_on_held_out_pages():
    pages = B.labelled_pages()
    train, test = pages[::2], pages[1::2]

    def table(part):
        x, page, line = B.features([("\n".join(t for _, t in lines), site) for site, lines in part], {})
        return x, np.asarray([part[p][1][i][0] for p, i in zip(page, line)])

    x, y = table(train)
    tree = B.Tree().fit(x, y)
    x, y = table(test)
    assert ((tree.predict(x) > 0.5) == y).mean() > 0.97


# --- splitting -----------------------------------------------------------------------------------------------------------


def check(text, spans, limit, overlap):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b in spans)
    rest = text[spans[0][0] : spans[0][1]]
    for (_, b), (c, d) in zip(spans, spans[1:]):
        rest += text[c:d][b - c :]
    assert rest == text


def test_split_round_trip():
    import random

    random.seed(4)
    for k in range(400):
        text = "".join(random.choice(["a", "б", " ", ". ", "\n", "\n\n", "\r\n", "é", "\U0001f468‍\U0001f469", ", "]) for _ in range(random.randint(1, 300)))
        limit, overlap = random.choice([(5, 0), (20, 5), (90, 20), (1, 0)])
        check(text, S.split_spans(text, limit, overlap), limit, overlap)
    assert S.split_spans("", 5, 1) == [] and S.split_spans("abc", 5, 1) == [(0, 3)]
    text = "One sentence here. " * 30 + "\n\n" + "Another paragraph follows. " * 30
    spans = S.split_spans(text, 700, 100)
    assert all(text[b - 1] in " \n" for _, b in spans[:-1])
    check("x" * 200_000, S.split_spans("x" * 200_000, 1600, 200), 1600, 200)


def test_items(spark):
    docs = spark.createDataFrame([(1, "word " * 500, "c"), (1, "word " * 500, "c"), (2, "short", "c"), (3, None, "c")], "id long, content string, piece string")
    pairs = spark.createDataFrame([("p", "word " * 400, ["a", None, "word " * 100]), (None, "", None), ("q", None, [])], "parent_id string, parent_content string, children_content array<string>")
    out = S.split_items(S.knowledge_items(docs, pairs), ("item_kind", "item_key", "pos"), "text").distinct()
    assert {(r["item_kind"], r["item_key"], r["pos"]) for r in out.collect()} == {("content", "1", 0), ("parent", "p", 0), ("child", "p", 2)}
    assert S.split_items(S.knowledge_items(docs.limit(0), pairs.limit(0)), ("item_kind", "item_key", "pos"), "text").count() == 0


# --- personal information --------------------------------------------------------------------------------------------------


def test_personal(spark):
    rows = [
        (1, "Скан отправила с anna.kern@mail.test, он дошёл?", {("EMAIL", "anna.kern@mail.test")}),
        (2, "Мой телефон +7 900 555-37-94.", {("PHONE", "+7 900 555-37-94")}),
        (3, "В заявке указан СНИЛС 188-096-023 55, это правильно?", {("ID", "188-096-023 55")}),
        (4, "Ich wohne Schulgasse 12/3/37.", {("ADDRESS", "Schulgasse 12/3/37")}),
        (5, "Меня зовут Вера Пихтич.", {("NAME", "Вера Пихтич")}),
        (6, "Надежда на визу ещё есть.", set()), (7, None, set()), (8, "", set()), (9, "Оплата 726,72 євро до 05.02.2026.", set()),
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t, _ in rows], "id long, text string, kind string")
    got = {}
    for r in D.find(df, "text", ("id",)).collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["surface"]))
    assert got == {i: s for i, _, s in rows if s}
    red = {r["id"]: r["redacted"] for r in D.redact(df, "text", ("id",)).collect()}
    assert red[1] == "Скан отправила с [EMAIL], он дошёл?" and red[7] is None and red[6] == rows[5][1]
    assert D.find(df.limit(0), "text", ("id",)).count() == 0
    long = "Погода хорошая. " * 20_000 + "Мой телефон +7 900 555-37-94."
    assert [k for _, _, k in D.field().decode([long])[0]] == ["PHONE"]


def test_field_on_held_out_sentences():
    data = D.labelled_sentences()
    own = D.train([x for i, x in enumerate(data) if i % 4])
    held = data[::4]
    found = own.decode([t for t, _ in held])
    hit = true = said = 0
    for (t, spans), got in zip(held, found):
        a, b = {(k, t[p:q]) for p, q, k in spans}, {(k, t[p:q]) for p, q, k in got}
        hit, true, said = hit + len(a & b), true + len(a), said + len(b)
    assert hit / true > 0.9 and hit / said > 0.9


# --- languages -------------------------------------------------------------------------------------------------------------


def test_languages(spark):
    ru, uk, de = "Студент может работать до двадцати часов в неделю.", "Студент може працювати до двадцяти годин на тиждень.", "Studierende dürfen bis zu zwanzig Stunden pro Woche arbeiten."
    rows = [
        (1, ru, "ru", None), (2, ru, " RU-ru ", None), (3, ru, None, {"ru"}), (4, uk, "ru", {"uk"}), (5, f"{ru} {de}", "ru", {"ru", "de"}), (6, None, None, None), (7, "123 !!", "xx", None), (8, "", "", None),
        (9, de.upper(), "Deutsch", None), (10, "Student mozhet rabotat do dvadtsati chasov v nedelyu.", "en", {"ru"}), (11, f"{ru} «{de[:30]}»", "ru", None), (12, (ru + " ") * 3000, "und", {"ru"}), (13, "Гэта вельмі добрае пытанне, дзякуй.", "bel", None),
    ]
    df = spark.createDataFrame([(i, t, x, "z") for i, t, x, _ in rows], "doc_id long, text string, lang string, languages string")
    got = {}
    for r in L.mislabelled(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["lang"])
        assert 0 < r["confidence"] <= 1
    assert got == {i: s for i, _, _, s in rows if s}
    parts = [(r["segment_no"], r["lang"]) for r in L.segments(df.where("doc_id = 5")).orderBy("segment_no").collect()]
    assert parts == [(0, "ru"), (1, "de")]
    assert L.mislabelled(df.limit(0)).count() == 0


def test_language_on_held_out_sentences():
    table = L.training_table()
    own = L.LanguageModel([x for i, x in enumerate(table) if i % 3])
    held = table[::3]
    found = L.detect([t for _, t in held], own)
    right = sum(bool(f[0]) and f[0][0][0] == lang for (lang, _), f in zip(held, found))
    assert right / len(held) > 0.97
