"""Training-data operators against brute force, exact round trips and awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("codexa.llm")

from codexa.llm import consistent as CO
from codexa.llm import leakage as LE
from codexa.llm import near_duplicates as ND
from codexa.llm import neighbours as NN
from codexa.llm import packing as PA
from codexa.llm import quality as QU
from codexa.llm import scanned as SC
from codexa.llm import splitting as SP
from codexa.llm import standing_lines as ST

RND = random.Random(11)
VOCAB = [a + b for a in "ba ce di fo gu hy ka lo mi".split() for b in "ran tel son mar dit pol".split()]


def sentence(n, rnd=RND):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


# problem 9


@pytest.mark.parametrize(
    ("text", "want", "forms"),
    [
        ("plain", "plain", []),
        ("", "", []),
        (None, None, []),
        ("Ｐａｙ ＄５，０００．", "Pay $5,000.", ["full_width"]),
        ("café résumé", "café résumé", ["combining"]),
        ("tre​at­ment", "treatment", ["zero_width"]),
        ("a plan of　care", "a plan of care", ["space"]),
        ("the cоdе for a vіsіt", "the code for a visit", ["look_alike"]),
        ("The РРО rules apply.", "The PPO rules apply.", ["look_alike"]),
        ("Use of α-blockers, 5 μm, Δ", "Use of α-blockers, 5 μm, Δ", []),
        ("Услуги перевода предоставляются в центре", "Услуги перевода предоставляются в центре", []),
        ("免费，无需预约。", "免费，无需预约。", []),
        ("family \U0001f468‍\U0001f469‍\U0001f467 cover", "family \U0001f468‍\U0001f469‍\U0001f467 cover", []),
        ("“quoted” – naïve Größe", "“quoted” – naïve Größe", []),
        ("ﬁnance ① 𝐇ello ｱｲｳ ｶﾞ ℌeader Ⅳ", "finance 1 Hello アイウ ガ Header IV", []),
        ("x² of ½ … ℹ️", "x² of ½ … ℹ️", []),
        ("an Ꭺpple", "an Apple", ["look_alike"]),
        ("они о хоре сор", "они о хоре сор", []),
    ],
)
def test_consistent(text, want, forms):
    got = CO.consistent(text)
    assert got == (want, forms)
    assert CO.consistent(got[0])[0] == got[0]


def test_consistent_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x​y"), (4, "z" * 200_000 + "​")], "doc_id long, text string").withColumn("forms", F.lit("clash"))
    assert {tuple(r) for r in CO.found_forms(df).collect()} == {(1, "space"), (4, "zero_width")}
    out = CO.with_consistent(df).collect()
    assert sorted((r.consistent_text or "")[:3] for r in out) == ["", "", "a b", "a b", "xy", "zzz"]
    assert CO.found_forms(df.limit(0)).count() == 0


def test_bigrams_are_counted_over_all_texts(spark):
    rows = [(i, "plain english words about a plan of care") for i in range(2500)] + [(9000, "x " * 2000 + "ресурс ресурсы"), (9001, "ресурсами"), (9002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = CO.fit_model(df)
    assert model.counts["ур"] == 3 and model.counts["pl"] == 5000 and model.counts["^w"] == 2500
    other = CO.fit_model(df.orderBy(F.desc("doc_id")).repartition(3))
    assert model.counts == other.counts and CO.fit_model(df.limit(0)).counts == {}


# problem 8


def test_leaks_by_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, sentence(rnd.choice([1, 5, 11, 14]), rnd), sentence(rnd.choice([8, 12, 20]), rnd)) for i in range(30)] + [(99, None, None), (100, "", "")]
    docs = []
    for d in range(60):
        t = sentence(60, rnd)
        if d % 3 == 0:
            w = rnd.choice(items[:30])[rnd.choice([1, 2])].split()
            t += "\n" + ", ".join(w[: rnd.choice([11, 12, 30])]).upper() + " " + sentence(5, rnd)
        docs.append((d, t))
    docs += [(70, None), (71, ""), (0, docs[0][1])]
    want = set()
    for d, t in docs:
        w = t and LE.words(t) or []
        for i, q, p in items:
            runs = [qw] if 0 < len(qw := LE.words(q or "")) < 12 else []
            runs += [v[i : i + 12] for v in (qw, LE.words(p or "")) for i in range(len(v) - 11)]
            for x in runs:
                if any(tuple(w[k : k + len(x)]) == tuple(x) for k in range(len(w))):
                    want.add((d, i))
    got = LE.leaked_items(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)), spark.createDataFrame(items, "item_id long, question string, passage string"))
    assert {tuple(r) for r in got.collect()} == want and want
    table = spark.createDataFrame(items, "item_id long, question string, passage string")
    assert {tuple(r) for r in LE.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), table, pass_chars=1500).collect()} == want
    none = spark.createDataFrame([], "item_id long, question string, passage string")
    assert LE.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_a_short_question_shortens_no_jumps_of_others():
    passage = tuple(LE.words(sentence(40)))
    alone, both = LE.WuManber({passage: [1]}), LE.WuManber({passage: [1], (b"two", b"words"): [2]})
    assert alone.tables[0][1] == both.tables[0][1] == 6 and len(both.tables) == 2
    assert both.search([b"x", *passage[5:17], b"two"]) == {1} and both.search([*passage[5:16], b"two", b"words"]) == {2}
    assert LE.WuManber({(b"a",) * 5000: [3]}).search([b"a"] * 11 + [b"b"] + [b"a"] * 11) == set()
    assert LE.WuManber({(b"a",) * 5000: [3]}).search([b"a"] * 12) == {3}


# problem 4


def test_cuts():
    long = "Word word word approx. " * 80
    assert SP.coarsest_cut("\n \n".join(["a" * 900] * 3)) == "paragraph"
    assert SP.coarsest_cut(("This is one sentence of some words. " * 60)) == "sentence"
    assert SP.coarsest_cut(long) == "word"
    assert SP.coarsest_cut("x" * 1401) == "forced"
    assert SP.coarsest_cut("\n".join(["words without an end"] * 100)) == "word"


def test_pieces():
    rnd = random.Random(4)
    for kind in range(4):
        text = {0: ". ".join(sentence(12, rnd).capitalize() for _ in range(60)) + ".", 1: "\n\n".join(sentence(60, rnd) for _ in range(12)), 2: sentence(900, rnd), 3: "q" * 5000}[kind]
        spans = SP.split_text(text)
        assert all(0 < e - b <= SP.MOST for b, e in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
        covered = 0
        for b, e in spans:
            assert b <= covered or not text[covered:b].strip()
            covered = e
        assert all(0 <= a[1] - b[0] <= 130 for a, b in zip(spans, spans[1:]))
    text = ". ".join(sentence(12, rnd).capitalize() for _ in range(300)) + "."
    cut = {text[b:e] for b, e in SP.split_text(text)}
    edited = text[:200] + "inserted words here " + text[200:]
    again = {edited[b:e] for b, e in SP.split_text(edited)}
    assert len(cut & again) >= 0.6 * len(cut)


def test_an_edit_alters_neighbouring_pieces_only():
    rnd, changed = random.Random(5), []
    for _ in range(200):
        text = "\n\n".join(" ".join(sentence(rnd.randint(5, 20), rnd).capitalize() + "." for _ in range(rnd.randint(1, 5))) for _ in range(60))
        at = rnd.randrange(len(text))
        edited = text[:at] + " " + rnd.choice(VOCAB) * rnd.randint(1, 3) + " " + text[at:]
        before, after = ({t[b:e] for b, e in SP.split_text(t)} for t in (text, edited))
        changed.append(len(after - before))
    assert sum(changed) <= 1.5 * len(changed) and sum(n <= 3 for n in changed) >= 0.98 * len(changed)


def test_pieces_at_boundaries_below_the_least_size():
    prose = "some words of prose " * 30
    for first, second in ((450, 1000), (450, 1380)):
        text = prose[: first - 1] + "x " + "q" * second
        assert [e for _, e in SP.split_text(text)] == [first, len(text)]
    for second in (1200, 1390):
        text = "A" + prose[:448] + "." + "\n\n" + ("More words of prose. " * 80)[: second - 1] + "."
        spans = SP.split_text(text)
        assert [e for _, e in spans] == [450, len(text)] and all(e - b <= SP.MOST for b, e in spans)


def test_pieces_are_cut_at_the_coarsest_boundary_that_will_do():
    rnd = random.Random(14)
    seen = set()
    for _ in range(1500):
        mean = rnd.choice([100, 400, 900])
        parts = [(sentence(200, rnd) if rnd.random() < 0.7 else "q" * 1600)[: int(rnd.expovariate(1 / mean)) + 1].strip() + rnd.choice([".", ".", ""]) for _ in range(rnd.choice([4, 8, 15]))]
        text = rnd.choice(["", "  ", "\n\n"]) + "".join(p + rnd.choice(["\n\n", " ", " ", "\n", " " * 700] if rnd.random() < 0.2 else ["\n\n", " "]) for p in parts)
        kind, spans = SP.cut_text(text)
        if kind is None:
            continue
        seen.add(kind)
        assert kind == SP.coarsest_cut(text)
        covered = 0
        for b, e in spans:
            assert 0 <= b < e and e - b <= SP.MOST and not text[min(covered, b) : b][covered - min(covered, b) :].strip() and e > covered
            covered = e
        assert not text[covered:].strip()
    assert seen == set(SP.LEVELS)


def test_split_table(spark):
    rows = [(3, "d", 7, 2, "Words end. " * 300), (1, "d", 0, None, None), (2, "d", 5, 1, "short"), (4, None, None, None, ""), (5, "d", 7000, 3, "late")]
    df = spark.createDataFrame(rows, "id long, document_id string, chunk_index int, page_number int, content string").withColumn("piece", F.lit("clash")).withColumn("n", F.lit(1))
    got = [r for r in SP.split_oversized(df).orderBy("chunk_index").collect() if r.document_id == "d"]
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert [r.id for r in got] == [1, 2] + [3] * (len(got) - 3) + [5] and len(got) > 4
    assert {r.page_number for r in got if r.id == 3} == {2}
    assert [tuple(r) for r in SP.found_cuts(df).collect()] == [(3, "sentence")]
    assert SP.split_oversized(df.limit(0)).count() == 0


def test_found_cuts_come_from_the_pieces(spark):
    # the plan runs the operator that makes the pieces, not a scan of the boundaries
    text = "\n\n".join(["one two three " * 30] * 5).strip()
    df = spark.createDataFrame([(1, "d", 0, None, text), (1, "d", 0, None, text), (None, "d", 1, None, text), (2, "d", 2, 4, "x" * 1401)], "id long, document_id string, chunk_index int, page_number int, content string")
    plan = SP.found_cuts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" in plan and "page_number" in plan
    assert {tuple(r) for r in SP.found_cuts(df).collect()} == {(1, "paragraph"), (2, "forced")}
    assert SP.split_oversized(df).where("id = 2").count() == 2


# problem 2


def _near(texts, least=0.6):
    sets = {}
    for f, k, t in texts:
        w = (t or "").lower().split()
        if len(w) >= 40:
            sets[f, k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def test_near_duplicates_by_brute_force(spark):
    rnd = random.Random(8)
    base = [sentence(rnd.choice([60, 90, 140]), rnd).split() for _ in range(60)]
    rows = [("content", f"k{i}", " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:30]):
        v = b[:]
        for _ in range(rnd.choice([1, 3])):
            v.insert(rnd.randrange(len(v)), rnd.choice(VOCAB))
        rows.append(("content", f"v{i}", " ".join(v)))
    rows += [("content", f"c{i}", " ".join(base[0])) for i in range(5)] + [("other", "o1", " ".join(base[0])), ("content", "n1", None), ("content", "n2", ""), ("content", "n3", "too short"), ("content", "k1", " ".join(base[1]))]
    df = spark.createDataFrame(rows, "field string, key string, text string").withColumn("th", F.lit(1)).withColumn("n", F.lit("clash"))
    want = _near(rows)
    for hot in (3000, 1):  # bands, and the exact way for hot ones
        got = {tuple(r) for r in ND.expanded(*ND.similar_pairs(df, hot=hot)).collect()}
        assert got == want and len(want) > 30
    assert ND.expanded(*ND.similar_pairs(df.limit(0))).count() == 0


def test_copies_beyond_the_bound_are_paired_with_their_first(spark):
    t = sentence(50)
    df = spark.createDataFrame([("content", f"{i:04}", t) for i in range(130)], "field string, key string, text string")
    got = {tuple(r) for r in ND.expanded(*ND.similar_pairs(df)).collect()}
    assert got == {("content", "0000", f"{i:04}") for i in range(1, 130)}


def test_bands_meet_without_being_kept_and_other_texts_stay(spark, monkeypatch):
    """All rows of shared bands were in a checkpoint before, and every text was sent where pairs are too many to be broadcast."""
    from pathlib import Path

    rnd = random.Random(3)
    base = [sentence(60, rnd) for _ in range(100)]
    rows = [("content", f"{i}x{j}", f"{b} end{j}") for i, b in enumerate(base) for j in range(3)]
    df = spark.createDataFrame(rows, "field string, key string, text string")
    folder = lambda: {f: f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file()}
    ND.similar_pairs(df.limit(0))  # sets the folder
    before = folder()
    links, keys = ND.similar_pairs(df)
    assert sum(n for f, n in folder().items() if f not in before) < 900 * len(rows)
    want = _near(rows)
    assert {tuple(r) for r in ND.expanded(links, keys).collect()} == want and len(want) == 300
    monkeypatch.setattr(ND, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in ND.expanded(*ND.similar_pairs(df)).collect()} == want
    ends = spark.createDataFrame([("content", "0x1"), ("content", "7x0")], "field string, key string")
    assert {r.key for r in ND._among(df, ["field", "key"], ends).collect()} == {"0x1", "7x0"}
    monkeypatch.setattr(ND, "HELD", 8)  # bands that go on over several batches
    assert {tuple(r) for r in ND.expanded(*ND.similar_pairs(df)).collect()} == want
    monkeypatch.setattr(ND, "BROADCAST_HASHES", 0)
    assert ND._among(df, ["field", "key"], ends).count() == len(rows)


def test_pairs_of_hot_bands_pass_no_likelihood(spark):
    hasher, pairs = ND.Hasher(), []
    for i in range(1500):
        a = [f"w{i}x{j}" for j in range(60)]
        pairs.append((a, a[:46] + [f"v{i}x{j}" for j in range(14)]))  # 44 of 72 runs in common
    a, b = (ND.sketch([hasher.runs([w.encode() for w in p[k]]) for p in pairs]) for k in (0, 1))
    band = (a == b).reshape(-1, ND.BANDS, ND.ROWS).all(2).any(1)
    n = np.full(len(pairs), 58.0)
    unlikely = ND.joint_similarity(a // ND.COARSE, b // ND.COARSE, n, n) < ND.LEAST - 2.5 * (ND.LEAST * (1 - ND.LEAST) / ND.REGISTERS) ** 0.5
    some = np.flatnonzero(band & unlikely)
    rows = [("content", f"{k}{i:04}", " ".join(p)) for i in some for k, p in zip("ab", pairs[i])]
    got = {tuple(r) for r in ND.expanded(*ND.similar_pairs(spark.createDataFrame(rows, "field string, key string, text string"), hot=1)).collect()}
    assert got == {("content", f"a{i:04}", f"b{i:04}") for i in some} and len(some) > 2


def test_joint_likelihood():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:1200], pool[600:1800]
    s = np.minimum(ND.sketch([np.sort(a), np.sort(b)]) // ND.COARSE, 255).astype(np.uint8)
    est = ND.joint_similarity(s[:1], s[1:], np.array([1200.0]), np.array([1200.0]))[0]
    assert abs(est - 600 / 1800) < 0.16


# problem 5


def test_similar_vectors_by_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((1500, 64))
    for i in range(200):
        x[1000 + i] = x[i] + 0.25 * rnd.standard_normal(64) * np.linalg.norm(x[i]) / 8
    x[1300:1304] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 64), (2002, [1.0]), (2003, [float("nan")] * 64), (2004, [float("inf")] + [1.0] * 63), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("shard", F.lit("clash")).withColumn("rep", F.lit(1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(1500) for j in range(i + 1, 1500) if s[i, j] >= 0.9}
    got = {(r.id_a, r.id_b) for r in NN.pairs_above(df, shard_rows=400, fit_rows=500).collect()}
    assert len(got - want) <= 1 and len(got & want) >= 0.98 * len(want) and len(want) > 100
    q = df.where("id % 50 = 0")
    near = {}
    for r in NN.nearest(df, q, 10, shard_rows=400, fit_rows=500).collect():
        near.setdefault(r.id, set()).add(r.other_id)
    hit = sum(len(near[i] & {int(j) for j in [k for k in np.argsort(-s[i]) if k != i][:10]}) for i in range(0, 1500, 50))
    assert hit >= 0.9 * 10 * 30
    assert NN.pairs_above(df.limit(0)).count() == 0 and NN.nearest(df.limit(0), q.limit(0)).count() == 0


# problem 7


def test_shards_stay_alike_in_size(spark):
    df = spark.range(120_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sqrt(-2 * F.log((F.abs(F.xxhash64("id", i)) % 1_000_003 + 1) / 1_000_004)) * F.cos(F.xxhash64(i, "id") % 1_000_003)).alias("embedding"))
    tree = NN._shards(df, 120_000, 128, 4000, 64)
    x = np.array([r.embedding for r in df.collect()])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    held = np.bincount(tree.home(x @ NN.projections(tree.depth)), minlength=1 << tree.depth)
    assert tree.depth == 10 and held.max() <= 2 * held.mean()


def test_packing():
    rnd = random.Random(6)
    sizes = [rnd.choice([0, 1, 2048, rnd.randint(1, 2048), int(rnd.expovariate(1 / 300)) % 2048]) for _ in range(3000)]
    boxes = PA.pack(sizes)
    assert sorted(i for b in boxes for i in b) == list(range(3000)) and all(sum(sizes[i] for i in b) <= 2048 for b in boxes)
    assert sum(sizes) / 2048 / len(boxes) > 0.98
    assert PA.pack([]) == [] and PA.pack([0, 0]) == [[0, 1]]


def test_containers(spark):
    docs = [(1, "word " * 5000), (2, None), (3, ""), (4, "short text"), (4, "short text"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("grp", F.lit("clash"))
    got = PA.containers(df).collect()
    counter = PA.Counter(open(PA.TOKENIZER, "rb").read())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert sum(r.tokens for r in by[1]) == counter.count(docs[0][1]) and [r.first_token for r in sorted(by[1], key=lambda r: r.part)] == [0, 2048, 4096]
    assert len(by[4]) == 2 and len(by[None]) == 1 and by[2][0].tokens == by[3][0].tokens == 0
    spans = {}
    for r in got:
        spans.setdefault(r.container, []).append((r.place, r.place + r.tokens))
    for s in spans.values():
        s.sort()
        assert s[-1][1] <= 2048 and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    assert PA.containers(df.limit(0)).count() == 0


# problem 1


def test_standing_lines(spark):
    rnd = random.Random(9)
    records, stats, titles, want = [], [], [], set()
    names = [a + b for a in ("Orvel", "Kestra", "Tamsin", "Brenda", "Ulrich") for b in ("dale", "mont", "by", "wick", "ford")]
    for d in range(40):
        doc, title = f"fam-{d:03}", f"Guide {d} to the covered {rnd.choice(VOCAB)} visits"
        stats += [(doc, "wrong" if d % 2 else "fam", "r0", 1), (doc, "fam", "r1", 2)]
        titles.append((doc, title if d % 3 else None))
        lines = [sentence(12, rnd).capitalize() + "." for _ in range(4)]
        if d < 20:
            at = rnd.randrange(5)
            line = f"Reviewed for the Norwick trust by {rnd.choice(names)} {rnd.choice(names)}, {rnd.randint(1, 28)} May 20{rnd.randint(10, 29)}"
            lines.insert(at, line.upper() if d == 7 else f"** {line} **" if d == 8 else line.lower() if d == 9 else line)
            want.add((f"c{d}", at))
        if d % 2:
            lines.append(f"Download {title} as a printable Norwick sheet")
            want.add((f"c{d}", len(lines) - 1))
        if d < 3:
            lines.append("Only three documents hold this line of words")
        records.append((f"c{d}", doc, "text", None, "\n".join(lines)))
    records += [records[0], ("n1", "fam-000", None, None, None), ("n2", None, "text", None, "x"), ("n3", "fam-001", "text", None, "")]
    rec = spark.createDataFrame(records, "chunk_id string, document_id string, content_type string, section string, text string").withColumn("family", F.lit("clash")).withColumn("title", F.lit("clash"))
    st = spark.createDataFrame(stats, "document_id string, family string, run_id string, created_at int")
    ti = spark.createDataFrame(titles, "document string, title string")
    found = ST.standing_lines(rec, st, ti)
    got = {(r.chunk_id, r.line_no) for r in found.collect()}
    assert got == want
    assert {(r.chunk_id, r.line_no) for r in ST.standing_lines(rec, st, ti, bound=0, group_texts=9).collect()} == want
    text = {r.chunk_id: r.text for r in ST.without_lines(rec, found).collect()}
    assert "Norwick" not in "".join(text[c] for c, _ in want) and text["n1"] is None and text["n3"] == ""
    assert ST.standing_lines(rec.limit(0), st, ti).count() == 0 and ST.standing_lines(rec, st.limit(0), ti).count() == 0


def test_standing_lines_of_short_words_in_capitals(spark):
    rnd = random.Random(12)
    records, want = [], set()
    for d in range(20):
        lines = [sentence(12, rnd).capitalize() + "." for _ in range(3)]
        lines[1:1] = ["DO NOT SEND CASH BY MAIL", sentence(9, rnd)]
        lines.append("Pay to " + "".join(rnd.choice("BCDFG") + rnd.choice("aeiou") for _ in range(4)).capitalize() + " at the door")
        want |= {(f"c{d}", 1), (f"c{d}", 5)}
        records.append((f"c{d}", f"d{d}", None, "\n".join(lines)))
    rec = spark.createDataFrame(records, "chunk_id string, document_id string, section string, text string").withColumn("content_type", F.lit("text"))
    st = spark.createDataFrame([(f"d{d}", "fam", "r0", 1) for d in range(20)], "document_id string, family string, run_id string, created_at int")
    for bound in ({}, {"bound": 0, "group_texts": 7}):  # chunks and templates sent to the tasks, and joined
        assert {(r.chunk_id, r.line_no) for r in ST.standing_lines(rec, st, **bound).collect()} == want


def test_long_standing_lines_and_semicolons_in_prose(spark):
    rnd = random.Random(13)
    notice = "this notice is given by the plan; " + sentence(70, rnd) + "; it holds for every member of the plan"
    row = "sealant of a tooth;yes;once in a year"
    records, stats, titles, want = [], [], [], set()
    for d in range(20):
        title = " ".join(rnd.sample(VOCAB, 18))
        lines = [sentence(12, rnd).capitalize() + ".", notice, row, f"Download {title} as a printable sheet"]
        want |= {(f"c{d}", 1), (f"c{d}", 3)}
        records.append((f"c{d}", f"d{d}", None, "\n".join(lines)))
        stats.append((f"d{d}", "fam", "r0", 1))
        titles.append((f"d{d}", title))
    rec = spark.createDataFrame(records, "chunk_id string, document_id string, section string, text string").withColumn("content_type", F.lit("text"))
    st = spark.createDataFrame(stats, "document_id string, family string, run_id string, created_at int")
    assert len(notice) > 400
    assert {(r.chunk_id, r.line_no) for r in ST.standing_lines(rec, st, spark.createDataFrame(titles, "document string, title string")).collect()} == want


@pytest.mark.parametrize(
    ("template", "line", "fits"),
    [
        ("a # b", "a x b", True), ("a # b", "a b", False), ("a # b", "a x b c", False), ("a # b", "a " + "x " * 40 + "b", True), ("# a b", "x a b", True), ("# a b", "a b", False),
        ("a b #", "a b x y", True), ("a b #", "a b", False), ("a b", "a b", True), ("a b", "a b c", False), ("a # b # c", "a b b x c", True), ("a # b # c", "a x b c", False),
        ("# a #", "a a x", True), ("# a #", "a x", False), ("# a # a", "x a a", False), ("# a # a", "x a a a", True), ("a # a", "a", False),
    ],
)
def test_blanks(template, line, fits):
    assert ST.Matcher(template).fits(line) is fits


# problem 3


def test_scanned(spark):
    body = ["The covered spouse may request the annual maximum for a sealant.", "The dental plan pays the annual maximum of the member share."]
    rows = [(f"p{i}", "fam-norwick-00000001", [9], " ".join(body)) for i in range(60)]
    rows += [
        ("s1", "fam-norwick-00000001", [1], "The covered sp0use may request the an-\n- 4 -\nGuide for Norwick Tamsin\nnual maximum for a seal¬\nant. The out-of-\nnetwork plan pays the mernber\nshare."),
        ("s2", "fam-norwick-00000001", [1], None), ("s3", None, None, ""), ("s1", "fam-norwick-00000001", [1], "The covered sp0use may request the an-\n- 4 -\nGuide for Norwick Tamsin\nnual maximum for a seal¬\nant. The out-of-\nnetwork plan pays the mernber\nshare."),
    ]
    rows += [(f"o{i}", "x", [1], "An out-of-network dentist.") for i in range(60)]
    rec = spark.createDataFrame(rows, "chunk_id string, document_id string, pages array<int>, text string").withColumn("title", F.lit("clash")).withColumn("document", F.lit(1))
    docs = spark.createDataFrame([("fam-norwick-00000001", "Guide for Norwick Tamsin", [1])], "document string, title string, image_only_pages array<int>")
    got = {tuple(r) for r in SC.line_defects(rec, docs).where("chunk_id = 's1'").collect()}
    assert {tuple(r) for r in SC.line_defects(rec, docs, bound=0).where("chunk_id = 's1'").collect()} == got
    assert got == {("s1", 0, "misread"), ("s1", 0, "split_word"), ("s1", 1, "page_furniture"), ("s1", 2, "page_furniture"), ("s1", 3, "split_word"), ("s1", 5, "misread")}
    text = {r.chunk_id: r.text for r in SC.repaired_text(rec, docs).collect()}
    assert text["s1"] == "The covered spouse may request the annual maximum for a sealant. The out-of-network plan pays the member share."
    assert text["s2"] is None and text["s3"] == ""
    assert SC.line_defects(rec.limit(0), docs.limit(0)).count() == 0


def test_explains():
    assert SC.explains("fliioride", "fluoride") == [2] and SC.explains("chnic", "clinic") == [1] and SC.explains("cat", "dog") is None


# problem 6


def test_kinds(spark):
    model = QU.fit_kinds([])
    right = sum(QU.KINDS[int(model.probabilities(np.array([QU.measures(t)])).argmax())] == k for k, t in QU.HOLDOUT)
    assert right >= 0.6 * len(QU.HOLDOUT)
    rows = [(f"t{i}", "d", "\n".join(f"{sentence(3).title()} ........ {j}" for j in range(2, 9))) for i in range(30)]
    rows += [(f"f{i}", "d", "\n".join(f"{sentence(2).title()} ___________" for _ in range(7))) for i in range(30)]
    rows += [(f"l{i}", "d", "\n".join(f"- {sentence(3)}, {sentence(1)}" for _ in range(7))) for i in range(30)]
    rows += [(f"j{i}", "d", "".join(RND.choice("abcXYZ0189+/=") for _ in range(400))) for i in range(30)]
    rows += [(f"p{i}", "d", " ".join(f"The {sentence(3)} of the {sentence(2)} is to be {sentence(2)} and it was for the {sentence(1)}." for _ in range(5))) for i in range(60)]
    rows += [("e1", "d", ""), ("e2", None, None), ("s1", "d", "The end of it."), ("t0", "d", rows[0][2])]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, text string").withColumn("words", F.lit("clash")).withColumn("kind", F.lit(0))
    got = {r.chunk_id: r.kind for r in QU.chunk_kinds(df).collect()}
    want = {"t": "toc", "f": "form", "l": "listing", "j": "junk", "p": "prose", "e": "tiny", "s": "tiny"}
    assert sum(got[k] == want[k[0]] for k in got) >= 0.98 * len(got) and got["e1"] == got["e2"] == got["s1"] == "tiny"
    d = QU.document_measures(QU.chunk_kinds(df)).collect()
    assert len(d) == 1 and d[0].toc == 30 and d[0].tiny == 2
    assert QU.chunk_kinds(df.limit(0)).count() == 0 and QU.text_measures(df.limit(0)).count() == 0


# all queries


def test_every_query_runs(spark):
    from pathlib import Path

    from codexa.llm import queries

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables")
    columns = {
        "p1_found": [("chunk_id", "string"), ("line_no", "int")], "p2_found": [("field", "string"), ("key_a", "string"), ("key_b", "string")],
        "p3_found": [("chunk_id", "string"), ("line_no", "int"), ("defect", "string")], "p4_found": [("id", "bigint"), ("cut", "string")],
        "p5_found": [("id_a", "bigint"), ("id_b", "bigint")], "p6_found": [("chunk_id", "string"), ("kind", "string")],
        "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p9_found": [("doc_id", "bigint"), ("form", "string")],
    }
    for name, q in queries.queries().items():
        df = q(spark, data)
        rows = df.collect()
        if name in columns:
            assert df.dtypes == columns[name], name
            assert len(rows) == len(set(rows)), name
        assert rows or name in ("p2_found", "p5_found", "p5_copies"), name



def test_sql_gives_the_same_rows(spark):
    import oracle
    from codexa.llm import queries as Q

    con = oracle.connect("/root/testdata/sf0.001")
    for name, sql in Q.oracle_sql().items():
        rows, why = oracle.compare(spark, con, Q.queries()[name], sql, "/root/testdata/sf0.001")
        assert (rows or name == "p5_copies") and not why, (name, why)
