"""Text operators: contracts against brute force, planted cases, and odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxfusion.llm import class_lm, decontaminate, html_extract, html_labelled, license_scan, mixing, pii, quality_model, quality_rules, queries, simhash, toxicity
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, spans string, hash long, code long, score double, id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return docs.orderBy("doc_id").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 30_000), (4, "word " * 30_000), (None, "no id at all"), (5, "x" * 200_000), (6, "a\x00b ퟿ é 日本 😀"), (7, None)]
    return spark.createDataFrame([(i, t, None, "s" if k % 2 else None, None, 1, 2, "x", 3, 4, 0.5, 9) for k, (i, t) in enumerate(rows)], ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "clicks"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, sql = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLES[name]).fetchdf()
    keys = [k for k in ("doc_id", "template_id", "item_id", "part", "filter_order", "step", "session_id") if k in mine]
    a, b = (d[sorted(d)].sort_values(keys).reset_index(drop=True) for d in (mine, sql))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_pages():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a> <a href=/b>About us</a></nav><header><h2>Site name</h2></header><div class='cookie notice'><p>We use cookies on this site.</p></div><article><h1>A head</h1><p>One &amp; two,\n <b>bold</b>er.<p>Three<br>four.<script>var x = '<p>no</p>';</script><!-- <p>hidden</p> --><div class=\"ad\">Buy things now please.</div><p>Five &lt; six.</p></article><form><label>Search here</label></form><div class=comments><p>I liked this very much indeed.</p></div><footer>&copy; 2024 all of us.</footer></body></html>"
    assert html_extract.extract(page) == "A head One & two, bolder. Three four. Five < six."
    assert [html_extract.extract(p) for p in (None, "", "<p>", "<nav>Menu</nav>")] == ["", "", "", ""]
    for p in ("<" * 3000, "<a " * 3000, "<p title='" * 3000, "<script>" * 50, "&#x110000; &bogus; <p", "<div>" * 3000 + "x"):
        html_extract.extract(p)
    for marked in html_labelled.pages(60, 123):
        want = " ".join(" ".join(m.split()) for m in re.findall("⁠([^<]*)", marked))
        assert html_extract.extract(marked.replace("⁠", "")) == want


def test_region_is_the_best():
    r = random.Random(1)
    for _ in range(200):
        xs = [r.choice((-3, -1, 1, 2)) * 1.0 for _ in range(r.randint(0, 12))]
        best = max((sum(xs[i:j]) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1)), default=0.0)
        i, j = html_extract.best_region(xs)
        assert sum(xs[i:j]) == max(best, 0.0)


def test_pages_query(spark):
    out = queries.op1_html_text(spark, SF).toPandas()
    assert (out.n_chars == out.text.str.len()).all() and (out.n_chars > 0).mean() > 0.95 and not out.text.str.contains("<").any()


def components(codes, most):
    low = list(range(len(codes)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= most:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return [root(k) for k in range(len(codes))]


def test_fingerprint():
    from xxhash import xxh64_intdigest

    t = "The Quick brown FOX jumps É over the quick Brown fox jumps"
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    h = [xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(len(w) - 3)]
    assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("one Two") == xxh64_intdigest(b"one two", 42) and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_simhash_equals_brute_force(spark, docs):
    got = simhash.near_duplicates(docs).orderBy("doc_id").toPandas()
    codes = [int(c) & (1 << 64) - 1 for c in got.code]
    assert [int(got.doc_id[k]) for k in components(codes, 4)] == got.component_id.tolist()


def test_index_loses_no_link_in_crowds(spark):
    """One value of many codes makes several leaves."""
    r = random.Random(2)
    codes = sorted({(0xABCDEF << 40) ^ sum(1 << b for b in r.sample(range(22), r.randint(0, 9))) for _ in range(3000)} | {r.getrandbits(64) for _ in range(500)})
    rows = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)), 0, 0, k) for k, c in enumerate(codes)], "code long, s1 long, s2 long, id long")
    found = simhash.components(simhash.links(simhash.cut(simhash.index(rows, simhash.block_patterns(6, 4))))).toPandas()
    a = np.array(codes, np.uint64)
    low = np.arange(len(a))
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a) <= 4)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        if (new == low).all():
            break
        low = new
    got = np.arange(len(a))
    got[found.id] = found.component_id
    assert (got == low).all()


def test_index_with_repeated_ids(spark):
    """One id on several codes, and leaves of one bucket that begin with the same id, lose no link."""
    r = random.Random(9)
    high = 0xABCDEF << 40
    codes = sorted({high ^ (r.getrandbits(21) << 8) for _ in range(1200)})
    by_rank = sorted(codes, key=lambda c: int(simhash.gray_rank(np.array([c], np.uint64))[0]))
    ids = {c: 7 if k % simhash.LEAF == 0 else 1000 + k for k, c in enumerate(by_rank)}
    rows = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)), 0, 0, ids[c]) for c in codes], "code long, s1 long, s2 long, id long")
    tree = simhash.cut(simhash.leaves(simhash.dealt(rows, [list(range(40, 64))]).coalesce(1).sortWithinPartitions("bucket", "rank")))
    assert tree.filter(F.get("ids", F.lit(0)) == 7).count() >= 2
    found = {x["id"]: x["component_id"] for x in simhash.components(simhash.links(tree)).collect()}
    low = {i: i for i in ids.values()}
    links = [(ids[a], ids[b]) for k, a in enumerate(codes) for b in codes[:k] if bin(a ^ b).count("1") <= 4]
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    # an id of several codes is one document: what it holds together is one component
    for _ in range(3):
        low = {i: low[low[i]] for i in low}
    assert {i: found.get(i, i) for i in low} == low


def test_copies_at_word_similarity(spark):
    """Copies of 0.85 and more are found but for a few; texts of 0.5 and less stay apart."""
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    sets = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, close, far = [], [], []
    for k in range(0, 600, 2):
        a = say(r.randint(80, 400))
        b = list(a)
        for p in r.sample(range(len(b)), max(1, int(len(b) * r.choice((0.004, 0.01, 0.12, 0.2))))):
            b[p] = "changed"
        rows += [(k, " ".join(a)), (k + 1, " ".join(b))]
        j = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
        (close if j >= 0.85 else far if j <= 0.5 else []).append(k + 1)
    kept = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, 600, 2)) <= kept and set(far) <= kept and len(far) > 100
    assert len(kept & set(close)) <= 0.03 * len(close) and len(close) > 100


def test_copies_equal_brute_force(spark, monkeypatch):
    """Pairs at 0.5 to 0.85 and a crowd of several blocks: the links are those of an exact similarity of 0.8."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(5)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts, crowd = [], say(150)
    for k in range(300):
        a = say(r.randint(60, 300))
        b = list(a)
        for p in r.sample(range(len(b)), int(len(b) * r.uniform(0.015, 0.08))):
            b[p] = "changed"
        texts += [a, b]
    for k in range(90):
        b = list(crowd)
        for p in r.sample(range(len(b)), k % 5):
            b[p] = f"new{k}"
        texts.append(b)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    low = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (i >= 600 or j == i + 1) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.copies(rows).collect()}
    assert got == dict(enumerate(low)) and 20 < sum(k != v for k, v in got.items() if k < 600) < 250


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(7, 3), (3, 7), (5, 5)]
    got = {r["id"]: r["component_id"] for r in simhash.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[k] for k in range(101, 161)} == {100} and {got[k] for k in range(201, 260)} == {200} and got[7] == 3 and 5 not in got


def test_toxicity(spark):
    sf = f"{DATA}/sf0.01"
    out = queries.op3_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all() and out.score.between(0, 1).all()
    hit = (out.predicted == 1) & (out.toxic == 1)
    assert hit.sum() >= 0.75 * (out.toxic == 1).sum() and ((out.predicted == 1) & (out.toxic == 0)).sum() <= 0.03 * len(out)


def test_kernel():
    k = toxicity.kernel(["abcd", "a-b-c-d", "wxyz"], ["abcd"])[:, 0]
    assert k[0] == pytest.approx(1.0) and 0.5 < k[1] < 1.0 and k[2] == 0.0
    m = toxicity.train_words({"idiot": 9, "moron": 5, "stupid": 7}, dict.fromkeys(["hello", "garden", "window", "river", "those", "editor", "idiom"], 3))
    v = dict(zip(("idiot", "i.d.i.o.t", "id-iot", "garden", "window"), m.margins(["idiot", "i.d.i.o.t", "id-iot", "garden", "window"]), strict=True))
    assert v["idiot"] > 0 and v["id-iot"] > v["garden"] and v["i.d.i.o.t"] > v["window"]
    assert toxicity.tokens("you i d i o t now")[-1] == "idiot"


def test_one_insult_in_a_sentence(spark):
    """Plain, upper-case, dotted, spaced, starred or hyphened, one insult makes a plain sentence toxic, and so do most with a letter put in."""
    sf, r = f"{DATA}/sf0.01", random.Random(4)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    say = "The committee met again to talk about the new bridge, and you are {} if you think that it will stand before winter sets in."
    rows = [("clean", say.format("right"))]
    for w in ("idiot", "trash", "stupid", "clown", "worthless", "pathetic"):
        rows += [("plain", say.format(x)) for x in (w, w.upper(), w.capitalize() + ",")]
        rows += [(kind, say.format(x)) for kind, x in (("dots", ".".join(w)), ("blanks", " ".join(w)), ("star", w[0] + "*" + w[1:]), ("hyphen", w[:2] + "-" + w[2:]))]
        rows += [("letters", say.format(w[:k] + r.choice("abcdefghijklmnopqrstuvwxyz") + w[k:])) for k in range(1, len(w))]
    # ids of any type
    df = spark.createDataFrame([(f"{kind} {k}", t) for k, (kind, t) in enumerate(rows)], "doc_id string, text string")
    hit = collections.defaultdict(list)
    for x in toxicity.score(df, model).collect():
        hit[x["doc_id"].split()[0]].append(x["score"] >= 0.5)
    share = {k: np.mean(v) for k, v in hit.items()}
    assert share["clean"] == 0 and share["plain"] == share["blanks"] == share["star"] == share["hyphen"] == 1 and share["dots"] >= 0.8 and share["letters"] >= 0.6, share


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True))
    assert m == 1.0 and toxicity.score(docs, m).count() == docs.count()
    assert toxicity.fit(docs, labels.limit(0), F.lit(True)) == 0.5


def test_license_scan(spark, odd):
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(999)}" for _ in range(n))
    rows = [(k, f"{say(r.randint(0, 90))} {text if k % 2 else text.upper()} {say(r.randint(0, 90))}") for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {(x["doc_id"], x["template_id"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, k) for k in range(len(rows))} <= got
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(odd.limit(0)).count() == 0


ITEM = "In June Alice bought 12 apples for 5 dollars and gave Alice 3 more apples today."


def test_decontamination(spark):
    same = ITEM.replace("Alice", "Carol").replace("12", "7").replace(" 3 ", " 9 ")
    mixed = same.replace("gave Carol", "gave David")
    d = spark.createDataFrame([(1, f"Some words before. {ITEM} And after."), (2, same), (3, mixed), (4, None), (5, ""), (6, "An unrelated text about apples and dollars."), (None, ITEM)], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    for most in (2_000_000, 0):
        got = {r["doc"] for r in decontaminate.contaminated(d, b, most_windows=most).collect() if r["doc"] is not None}
        assert got == {1, 2}
    assert sorted(r["doc_id"] or 0 for r in decontaminate.remove(d, b).collect()) == [0, 3, 4, 5, 6]
    assert decontaminate.remove(d, b.limit(0)).count() == 7 and decontaminate.remove(d.limit(0), b).count() == 0


def test_one_edited_slot_hides_no_copy(spark):
    """One edited occurrence of a repeated name, or two numbers that become one, discount their own windows only."""
    item = "In the old town the baker Miller sold 12 loaves to each of his best friends before noon and then the same Miller gave 7 of the loaves that were left to the poor people of the town near the river and went home where Miller slept"
    texts = [item, item.replace("same Miller", "same Smith"), item.replace("12", "5").replace(" 7 ", " 5 "), item.replace("same Miller", "same Smith").replace("12", "9")]
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(k, f"Once more. {t}") for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc"]: r for r in decontaminate.matches(d, b).collect()}
    assert got[0]["coverage"] == got[2]["coverage"] == 1 and got[0]["consistent"] and not got[1]["consistent"]
    assert got[1]["item_windows"] - got[1]["matched"] == 8 and 0 < got[3]["matched"] < got[1]["matched"]
    assert {0, 1, 2} <= {r["doc"] for r in decontaminate.contaminated(d, b).collect()}
    assert decontaminate.judge([(0, ["1a"], ["1b"]), (1, ["1a"], ["1c"]), (2, ["1a"], ["1a"]), (3, ["1d"], ["1b"])]) == ([2, 3], False)


def test_long_quotation_of_a_long_item(spark):
    r = random.Random(4)
    item = [f"word{''.join(r.choices('abcdefgh', k=6))}" for _ in range(500)]
    d = spark.createDataFrame([(1, " ".join(["Before it."] + item[100:300])), (2, " ".join(item[40:50])), (3, "Nothing of it at all is in this text here.")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc"]: r for r in decontaminate.matches(d, b).collect()}
    assert got[1]["run"] == 200 and got[1]["coverage"] < 0.4 and got[2]["run"] == 10
    assert [r["doc"] for r in decontaminate.contaminated(d, b).collect()] == [1]
    assert decontaminate.longest_run([]) == 0 and decontaminate.longest_run([1, 2, 5, 6, 7, 9]) == 3


def test_items_without_a_literal_window(spark):
    items = ["Compute 12 * 7", "Alice 12, Bob 7, Carol 9, David 11, Erin 14, Frank 21", "\nName the longest river of Africa\n", "Paris is big"]
    texts = ["We had to compute 12 * 7 then.", f"See {items[1]} there.", f"and then {items[2].strip()} was asked", "they said Paris is big again", "Compute 13 * 7", "Paris was big"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (2_000_000, 0):
        assert sorted((r["doc"], r["item"]) for r in decontaminate.contaminated(d, b, most_windows=most).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_decontamination_equals_brute_force(spark, docs, plain):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, SF).collect()}
    tokens, of, want = decontaminate.Tokens(), collections.defaultdict(set), set()
    total = {}
    for i, t in zip(bench.item_id, bench.text, strict=True):
        h = decontaminate.window_hashes(tokens.of(t)[1], 8).tolist()
        total[i] = len(h)
        for p, x in enumerate(h):
            of[x].add((i, p))
    for i, t in zip(plain.doc_id, plain.text, strict=True):
        hit = collections.defaultdict(set)
        for x in decontaminate.window_hashes(tokens.of(t)[1], 8).tolist():
            for item, p in of.get(x, ()):
                hit[item].add(p)
        want |= {(i, k) for k, ps in hit.items() if len(ps) >= 0.5 * total[k]}
    assert got == want and got


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if ok else []
    return out


def test_personal_data(spark, plain):
    got = queries.op6_pii(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(plain.doc_id, plain.text, strict=True):
        spans = base_spans(t)
        row = got.loc[i]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(row.spans.split(","))


def test_personal_data_in_odd_texts(spark):
    r = random.Random(1)
    bits = ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004", "123.45.6.7", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "a@b.c_d@e.f", "+1 (555) 123-4567", "x.y%z@a-b.co.uk", "Mr. John Smith", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "😀"]
    rows = [(k, "".join(r.choice("0123456789" * 3 + " -.+()@ab_%é😀\n") if r.random() < 0.6 else r.choice(bits) for _ in range(r.randint(0, 60)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "7" * 9000 + " a@b." + "c." * 3000 + "d " + "z" * 9000 + " 1.2" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = pii.fit(df)
    found = pii.find(df, m).select("doc_id", "text", pii.joined(F.col("spans")).alias("s")).collect()
    for x in found:
        mine = [s for s in x["s"].split(",") if s.split(":")[0] in PATTERNS]
        assert mine == [f"{k}:{a}:{b}" for k, a, b in base_spans(x["text"])]
    clean = pii.redact(df, m)
    assert clean.count() == len(rows) and clean.filter("doc_id < 1000").filter(F.col("text").rlike("4111-1111-1111-1111(?![- 0-9])") & ~F.col("text").rlike("[0-9] ?-?4111-1111")).count() == 0
    one = pii.redact(spark.createDataFrame([("mail a@b.cd or +1 (555) 123-4567!",)], "text string"), m).first()["text"]
    assert one == "mail <EMAIL> or <PHONE>!"
    long = spark.createDataFrame([("7" * 200_000 + " a@b." + "c." * 50_000 + "d " + "z" * 300_000 + " 1.2" * 1000,)], "text string")
    assert pii.redact(long, m).first()["text"].startswith("7" * 200_000 + " <EMAIL> z")


def test_span_classifier_decides(spark):
    """False account, security and commit numbers and streets that look like names go, true ones stay; base kinds stay in any case."""
    r = random.Random(2)
    d = lambda n: "".join(r.choices("0123456789", k=n))
    hexes = lambda: "".join(r.choices("0123456789abcdef", k=38)) + "a1"

    def iban(right: bool) -> str:
        body = d(18)
        check = 98 - int(body + "131400") % 97  # D = 13, E = 14
        return f"DE{check if right else (check + 1 + r.randrange(90)) % 97 + 1:02}{body}"

    def ssn(right: bool) -> str:
        return f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" if right else r.choice((f"000-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{r.randint(100, 665)}-00-{d(4)}"))

    say = {
        "iban": (lambda: f"my bank account {iban(True)} is", lambda: f"see order no {iban(False)} for"), "ssn": (lambda: f"his social security number {ssn(True)} was", lambda: f"see part no {ssn(False)} of"),
        "secret": (lambda: f'token = "{hexes()}" in', lambda: f"in commit {hexes()} we"), "name": (lambda: f"met Mr. {r.choice(('John', 'Anna', 'David'))} Smith again", lambda: f"at Dr. {r.choice(('Lorem', 'Ipsum'))} Ave near"),
    }
    rows = [(f"{kind} {right}", say[kind][not right](), kind, right) for kind in say for right in (True, False) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, kind string, right boolean")
    model = pii.fit(df)
    assert all(0.55 <= v <= 0.99 for v in model.reliability.values()) and model.reliability["checksum"] > 0.7
    found = pii.find(df, model).select("kind", "right", pii.joined(F.col("spans")).alias("s")).collect()
    kept = collections.Counter((x["kind"], x["right"]) for x in found if f"{x['kind']}:" in x["s"])
    assert all(kept[k, True] >= 38 and kept[k, False] <= 4 for k in say), kept
    base = spark.createDataFrame([("see order no 10.0.0.1 for",), ("version 1.2.3.4",)], "text string")
    assert all(x["spans"] for x in pii.find(base, model).collect())


def test_many_spans_in_a_text(spark):
    """The time grows little more than in proportion, and places are right."""
    n = 20_000
    df = spark.createDataFrame([(" ".join(f"a{k}@b.cd" for k in range(n)),)], "text string")
    began = time.perf_counter()
    clean = pii.redact(df, pii.Model()).first()["text"]
    assert clean == " ".join(["<EMAIL>"] * n) and time.perf_counter() - began < 90


def test_quality_rules(spark, odd):
    good = "This is a plain sentence of many quite ordinary words. " * 2
    varied = " ".join(f"Sentence{k} tells{k} something new{k} about topic{k * 7}." for k in range(20))
    rows = [(1, varied), (2, varied + "\nHome | About | News | Contact | Login\n" + "Licensed under the MIT License."), (3, "\n".join(f"a{k} | b{k} | c{k} | d{k} | e{k}" for k in range(30))), (4, good * 20), (5, "short.")]
    out = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k]["kept"] for k in range(1, 6)] == [True, True, False, False, False]
    assert out[2]["clean_text"] == varied and out[4]["base_failed"]
    kept = quality_rules.clean(spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: varied, 2: varied} and all(r["n_chars"] == len(varied) for r in kept)
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.clean(odd).columns == odd.columns


def test_stock_phrases_are_whole(spark):
    """Prose that holds them in part, or as a topic, stays; boilerplate goes."""
    prose = ["The dialog in the second act is slow.", "An analog input reads the voltage.", "She wrote about copyright in the novel.", "The film was released under another title.", "He learned javascript at school.", "In terms of service the hotel was fine.", "word " * 15 + "ends. " + "word " * 15 + "ends. " + "word " * 12 + "5", "The baker sold cookies at the fair."]
    stock = ["Please log in to read on.", "Privacy policy and terms of use", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Copyright 2020 by us.", "This site uses cookies.", "Subscribe to our newsletter", "Released under the MIT License.", "word " * 45]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(prose + stock)], "k int, x string")
    assert [r["ok"] for r in df.select("k", quality_rules.line_passes(F.col("x")).alias("ok")).orderBy("k").collect()] == [True] * len(prose) + [False] * len(stock)
    for f in (quality_rules.clean, mixing.mixture):
        with pytest.raises(ValueError, match="reserved"):
            f(df.selectExpr("k as doc_id", "x as text", "'s' as source", "1 as __kept__"))


def test_language_model(spark, plain):
    got = queries.op8_class_lm(spark, SF).toPandas().set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in plain.doc_id}
    words = {i: t.encode().lower().split() for i, t in zip(plain.doc_id, plain.text, strict=True)}
    c = collections.Counter(w for i in words if not held[i] for w in words[i])
    end = sum(not h for h in held.values())
    n, v = sum(c.values()) + end, len(c) + 1
    for i, ws in words.items():
        assert got.loc[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((end + 1) / (n + v + 1)))
        assert (got.loc[i].n_tokens, got.loc[i].n_known, got.loc[i].train_tokens) == (len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
    mine = got[[held[i] for i in got.index]]
    assert mine.score.sum() > mine.base_score.sum()  # held-out texts are likelier under classes


def test_language_model_with_a_small_head(spark, docs):
    """What is joined gives what is sent."""
    a, b = (class_lm.score(docs, class_lm.fit(docs, F.lit(True), head=n, seeds=50, least=10**9)).orderBy("doc_id").toPandas() for n in (300_000, 400))
    assert np.allclose(a.base_score, b.base_score) and np.allclose(a.score, b.score) and (a.n_known == b.n_known).all()


def test_exchange_finds_the_classes():
    """Words of two kinds that follow each other in turn."""
    r = np.random.default_rng(0)
    pairs = np.zeros((21, 21))
    for a in range(20):
        for b in range(20):
            if (a < 10) != (b < 10):
                pairs[a, b] = r.integers(5, 15)
    of = class_lm.exchange(pairs, 20, 2)
    assert len(set(of[:10])) == len(set(of[10:20])) == 1 and of[0] != of[10]


def test_quality_model(spark):
    sf = f"{DATA}/sf0.01"
    out = queries.op9_quality_model(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert ((out.predicted == 0) & (out.quality == 0)).sum() >= 0.9 * (out.quality == 0).sum() and ((out.predicted == 0) & (out.quality == 1)).sum() <= 0.02 * len(out)


def test_mixing_reaches_targets(spark, odd):
    r = random.Random(5)
    rows = [(k, " ".join(["w"] * r.randint(0, 40)), r.choice(["a"] * 12 + ["b", "c", "d", None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).toPandas().merge(df.toPandas()[["doc_id", "source"]], on="doc_id")
    assert out.target.groupby(out.source.fillna("~")).first().sum() == pytest.approx(out["size"].sum())
    for _, g in out.groupby(out.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 41 and (g.taken <= 3 * g["size"]).all() and g.target.iloc[0] <= 3 * g.source_size.iloc[0] + 1e-9
    assert out.equals(mixing.mix(df.repartition(7)).toPandas().set_index("doc_id").loc[out.doc_id].reset_index().merge(df.toPandas()[["doc_id", "source"]], on="doc_id"))
    a, b = (mixing.mixture(df, most_sent=n).select("doc_id", "copies", "taken").toPandas().sort_values("doc_id").reset_index(drop=True) for n in (100, 0))
    want = out[out.taken > 0][["doc_id", "taken"]].sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b) and a[["doc_id", "taken"]].equals(want)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0 and mixing.mixture(odd).count() > 0


def test_targets_equal_resharing():
    """The level is what sharing the excess again and again comes to."""
    from pyspark.sql import SparkSession

    spark, r = SparkSession.getActiveSession(), random.Random(6)
    for _ in range(5):
        sizes = {f"s{k:02}": r.choice((0, 1, 10, 1000, 50_000)) for k in range(9)}
        w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes))}
        left, open_, target = float(sum(sizes.values())), set(sizes), {}
        while open_:
            level = left / sum(w[s] for s in open_)
            above = {s for s in open_ if level * w[s] > 3 * sizes[s]}
            if not above:
                target |= {s: level * w[s] for s in open_}
                break
            target |= {s: 3.0 * sizes[s] for s in above}
            left -= sum(3 * sizes[s] for s in above)
            open_ -= above
        got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (1, 2, 3), 3).collect()}
        assert got == pytest.approx(target)


def test_operators_bear_odd_tables(spark, odd):
    n = odd.count()
    assert simhash.near_duplicates(odd).count() == n and simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6]
    assert pii.find(odd).columns == odd.columns and pii.redact(odd).columns == odd.columns and pii.redact(odd.limit(0)).count() == 0
    m = class_lm.fit(odd, F.col("doc_id") > 1)
    assert class_lm.score(odd, m).count() == n and class_lm.score(odd.limit(0), m).count() == 0
    assert class_lm.score(odd, class_lm.fit(odd.limit(0), F.lit(True))).count() == n
    q = quality_model.fit(odd)
    assert quality_model.score(odd, q).count() == n and quality_model.fit(odd.limit(0)) is None
    b = spark.createDataFrame([(1, "word word word word word word word word word", 0)], "item_id long, text string, doc long")
    assert decontaminate.remove(odd, b).columns == odd.columns
    t = toxicity.fit(odd, spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(odd, t).count() == n
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>A line of words that goes on for long enough.</p>", "y")], "page_id long, url string, html string, text string")
    assert html_extract.main_text(pages).columns == pages.columns and html_extract.main_text(pages.limit(0)).count() == 0


def passing_lines(text):
    """The rules on lines, in plain Python."""
    whole = lambda p: re.compile(rf"(?:^|[^\W_]|_)(?!)|(?:^|[\W_])(?:{p})(?:$|[\W_])")
    stock = whole(r"all rights reserved|click here|(?:licensed|released) under (?:cc by|[^.]{0,60}licen[cs]e)|copyright (?:©|\(c\)|[0-9]{4})|(?:accept|uses?|using) cookies|(?:enable|requires?) javascript|subscribe to our")
    topic = whole(r"terms of (?:use|service)|privacy policy|cookies?|javascript|sign (?:in|up)|log ?in|subscribe|newsletter|copyright")
    reader = whole(r"please|our|your?|this (?:web)?(?:site|page)")
    out = []
    for line in (text or "").split("\n"):
        t = line.strip(" \t\n\x0b\x0c\r")
        n, low, ended = len(t.split()), t.lower(), bool(re.search(r"""[.!?:;…。！？]["'”’»)\]]*$""", t))
        fails = sum(map(t.count, "#*$%&|<>")) > 0.3 * n or (t.count("|") >= 2 and t.count("|") > 0.2 * n) or (n >= 8 and t.upper() == t != t.lower())
        fails = fails or (not ended and (n < 3 or (n > 40 and 40 * sum(map(t.count, ".!?…。！？")) < n)))
        if t and not fails and not (n <= 30 and (stock.search(low) or (topic.search(low) and (not ended or reader.search(low))))):
            out.append(line)
    return out


def test_stages_equal_brute_force(spark, docs, plain):
    """Rules in plain Python, near duplicates over all pairs, the mix by SQL, each over what the stage before left."""
    stage = dict(corpus_pipeline.STAGES)
    want = {}
    for i, t in zip(plain.doc_id, plain.text, strict=True):
        w, kept = t.split(), passing_lines(t)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        chars = sum(len(x) for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and chars - sum(map(len, kept)) <= 0.5 * chars:
            want[i] = "\n".join(kept).replace("\n", "")
    first = simhash.cut(stage["quality_rules"](spark, docs, SF))
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    assert {i: t.replace("\n", "") for i, t in texts.items()} == want

    ids = sorted(texts)
    words = [texts[i].lower().split() for i in ids]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    low = list(range(len(ids)))
    links = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    second = simhash.cut(stage["near_duplicates"](spark, first, SF))
    assert sorted(r["doc_id"] for r in second.collect()) == [ids[k] for k in sorted(set(low))] and links

    c = duckdb.connect()
    c.register("documents", second.toPandas())
    taken = {i: t for i, t in c.execute("SELECT doc_id, taken FROM (" + queries.ORACLES["op10_mixing"] + ") WHERE taken > 0").fetchall()}
    assert {r["doc_id"]: r["taken"] for r in stage["mixing"](spark, second, SF).collect()} == taken


def test_pipeline(spark, docs, plain):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "pii", "mixing"]
    got = corpus_pipeline.run(spark, SF).toPandas()
    kept = quality_rules.judge(docs).filter("kept").toPandas()
    texts = dict(zip(kept.doc_id, kept.clean_text, strict=True))
    assert set(got.doc_id) <= set(texts) and got.doc_id.is_unique and (got.taken == got["size"] * got.copies).all()
    for t in got.text:
        assert not [s for s in base_spans(t) if s[0] in ("email", "ip")]
    leaked = {r["doc_id"] for r in queries.op5_decontamination(spark, SF).collect()}
    assert not leaked & set(got.doc_id)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_fingerprints_propose_copies(spark):
    """the stage's candidates come from the index of fingerprints, all pairs of at most four differing bits."""
    r = random.Random(8)
    texts = []
    for _ in range(60):
        a = [f"w{r.randrange(2000)}" for _ in range(r.randint(100, 500))]
        texts += [" ".join(a), " ".join(["changed", *a[1:]]), " ".join([*a, a[0]])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash.cut(simhash.shingle_sets(rows, "doc_id", "text", 5))
    codes = {x["id"]: x["code"] % 2**64 for x in prints.collect()}
    assert all(codes[k] == simhash.fingerprint(t, 5) for k, t in enumerate(texts))
    low = list(range(len(texts)))
    links = [(a, b) for a in low for b in low[:a] if (codes[a] ^ codes[b]).bit_count() <= 4]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {x["id"]: x["component_id"] for x in simhash.components(simhash.proposed(prints.select("code", "id"), 4)).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == low and len(links) > 60


def test_copies_of_a_crowd_stay_small(spark, monkeypatch):
    """A crowd of many blocks is verified in rows that follow from its size, and rounds of few edges lie in few files."""
    from pyspark.sql.group import GroupedData

    met, files, at = [], [], iter(range(10**6))
    real, cut = GroupedData.applyInArrow, simhash.checkpointed
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: (met.append(self._df.count()), real(self, *a))[1])
    monkeypatch.setattr(simhash, "checkpointed", lambda df: (out := cut(df), files.append(out.rdd.getNumPartitions()))[0])
    monkeypatch.setattr(simhash, "BLOCK", 16)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        w = [f"w{k}" for k in range(200)]
        texts = [" ".join([*w[: k % 190], f"new{next(at)}", *w[k % 190 + 1 :]]) for k in range(160)]
        got = simhash.copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r["component_id"] for r in got} == {0} and len(got) == 160
    assert 160 <= sum(met) <= 2 * 160
    assert sum(n > 8 for n in files) <= 2 and len(files) > 8  # the first edges of both searches for components


def test_links_with_buckets_told(spark):
    """Leaves of the buckets that are told to the tasks yield the components of those that meet by bucket."""
    r = random.Random(3)
    codes = sorted({c ^ (1 << r.randrange(40)) ^ (1 << r.randrange(40)) for c in (r.getrandbits(40) for _ in range(12)) for _ in range(150)})
    rows = spark.createDataFrame([(c, 0, 0, k) for k, c in enumerate(codes)], "code long, s1 long, s2 long, id long")
    tree = simhash.cut(simhash.leaves(simhash.dealt(rows, [list(range(40, 64))]).coalesce(1).sortWithinPartitions("bucket", "rank")))
    assert tree.count() > 1
    assert {tuple(x) for x in simhash.components(simhash.links(tree, most_sent=10)).collect()} == {tuple(x) for x in simhash.components(simhash.links(tree)).collect()} != set()


def test_lone_leaves_are_not_written(spark):
    """The only members of their buckets, nearly all of an index's rows, are left out, and no link goes with them: buckets
    that go on in another task or batch, or in several leaves, keep all their leaves."""
    r = random.Random(5)
    codes = [r.getrandbits(24) << 40 for _ in range(4000)]
    crowd = 0x123456 << 40
    codes = sorted({*codes, *(crowd ^ (r.getrandbits(20) << 8) for _ in range(simhash.LEAF + 1)), *(c ^ 1 for c in codes[::40])})
    rows = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)), 0, 0, k) for k, c in enumerate(codes)], "code long, s1 long, s2 long, id long")
    dealt = simhash.dealt(rows, [list(range(40, 64))])
    tree = simhash.cut(simhash.tree_of(dealt))
    ranged = dealt.repartitionByRange(8, "bucket", "rank").sortWithinPartitions("bucket", "rank")
    whole = simhash.cut(simhash.leaves(ranged))
    met = {x["bucket"] for x in whole.groupBy("bucket").agg(F.sum(F.size("ids")).alias("n")).filter("n > 1").collect()}
    assert len(met) > 100 and met <= {x["bucket"] for x in tree.collect()}
    assert tree.count() <= len(met) + 8 * 4 < whole.count()
    found, want = ({tuple(x) for x in simhash.components(simhash.links(t)).collect()} for t in (tree, whole))
    assert found == want != set()


def test_small_clusters_are_not_held_twice(spark, monkeypatch):
    """Only what is beyond the hub of a large cluster is shuffled again, and sets do not meet the counts of their clusters by
    a shuffle."""
    from boxfusion.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(4)
    rows = []
    for c in range(0, 3000, 100):  # one of 90, else of 3 documents; some are far from the first
        base = list(range(c * 1000, c * 1000 + 100))
        for k in range(90 if c == 0 else 3):
            s = sorted({*base[: 60 if k % 30 == 2 else 97], *(r.getrandbits(60) for _ in range(2))})
            rows.append((c, c + k, len(s), s))
    sets = simhash.cut(spark.createDataFrame(rows, "cluster long, id long, size long, shingles array<long>").repartition(4))
    held = minhash.confirmed(sets, 0.8)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    got = {x["id"]: x["component_id"] for x in simhash.components(held).collect()}
    low, full = {x[1]: x[1] for x in rows}, {x[1]: set(x[3]) for x in rows}
    links = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and len(full[a[1]] & full[b[1]]) >= 0.8 * len(full[a[1]] | full[b[1]])]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert {i: got.get(i, i) for i in low} == low
