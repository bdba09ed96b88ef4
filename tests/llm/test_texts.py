"""Languages, leaks, look-alikes and near duplicates."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from audiolake.llm import languages, leakage, lookalikes, neardup, neardup_kernel
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"
EN = "The archive holds letters about the mine and she has read them all. This week we talk about the harbour and why it still matters. "
DE = "Im Jahr kannte niemand mehr die Hafenbahn und doch war es nie um das Geld gegangen. Unser Gast hat lange die Schlafforschung erforscht. "
FR = "Les archives gardent des lettres sur la mine et elle les a toutes lues. Cette semaine nous parlons avec lui du port. "


def test_languages_and_passages(spark):
    train = [("en", EN), ("de", DE), ("fr", FR)] * 6
    data = [(i, lab, t) for i, (lab, t) in enumerate(train)]
    data += [(100, "de", EN * 4), (101, None, DE), (102, "en_GB", EN * 4 + DE), (103, "und", ""), (104, None, None), (105, "French", FR * 3), (106, "en", "12345 !!"), (107, "en", EN * 3000)]
    df = spark.createDataFrame([(*r, "mine") for r in data], "record_id long, label string, text string, confidence string")
    got = {r.record_id: r for r in languages.identify(df).collect()}
    assert [got[i].language for i in (100, 101, 102, 103, 104, 105, 106, 107)] == ["en", "de", "en", None, None, "fr", None, "en"]
    assert [got[i].named for i in (100, 101, 102, 103, 105)] == ["de", None, "en", None, "fr"]
    assert [(p.language, p.sentences) for p in got[102].passages] == [("de", 2)]
    assert 0 <= got[102].confidence <= 1 and got[103].confidence == 0
    assert languages.identify(df.limit(0)).count() == 0
    assert {r.language for r in languages.identify(df.withColumn("label", F.lit(None).cast("string"))).collect()} == {None}


def test_held_out_languages(spark):
    """Records whose label names a language agree with it but for the planted wrong ones."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("label"), "text")
    done = languages.identify(docs).filter("named is not null")
    assert done.filter("named = language").count() / done.count() > 0.85


def brute_runs(items, docs, run):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, a in items:
        wa = words(a)
        grams = {tuple(wa[k : k + run]) for k in range(len(wa) - run + 1)}
        for j, b in docs:
            wb = words(b)
            if any(tuple(wb[k : k + run]) in grams for k in range(len(wb) - run + 1)):
                out.add((i, j))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e"] * 8 + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(12)] + [(50, None), (51, ""), (52, "x " * 30), (53, "short one")]
    docs = [(j, text(60)) for j in range(60)] + [(900, None), (901, ""), (902, "X, x! " * 50)]
    for j in range(100, 140):
        i, t = rng.choice(items[:12])
        w = t.split()
        at, n = rng.randrange(15), rng.choice([10, 11, 12, 13, 15])
        docs.append((j, text(20) + " " + ", ".join(w[at : at + n]).upper() + ". " + text(20)))
    docs += docs[100:103]
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    do = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(it, do).collect()}
    assert got == brute_runs(items, docs, 12) and (52, 902) in got
    assert leakage.leaks(it.limit(0), do).count() == leakage.leaks(it, do.limit(0)).count() == 0
    assert leakage.proximity(it, do, least_share=0.9).filter("item_id = 52").count() == 1


def brute_spans(items, docs, least_share, slack):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, a in items:
        wa = words(a)
        for j, b in docs:
            wb = words(b)
            starts = {p - k - slack for p, w in enumerate(wb) for k, x in enumerate(wa) if w == x}
            most = max((len(set(wa) & set(wb[max(0, s) : max(0, s + len(wa) + 2 * slack)])) for s in starts), default=0)
            if most and most / len(set(wa)) >= least_share:
                out[i, j] = most
    return out


def test_proximity_equals_brute_force(spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(15)]
    items, docs = [], [(j, " ".join(rng.choice(common) for _ in range(50))) for j in range(40)]
    for i in range(25):
        w = [rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(60)}" for _ in range(rng.choice([6, 9, 20, 35]))]
        items.append((i, " ".join(w)))
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(0, len(w) // 4 + 2)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                v = v[len(v) // 2 :] + v[: len(v) // 2]
            head = [rng.choice(common) for _ in range(rng.randrange(30))]
            docs.append((100 + len(docs), " ".join(head + v) + " the end"))
    items += [(50, None), (51, ""), (52, " ".join(f"absent{k}" for k in range(3)) + " " + items[2][1]), (53, "two words")]
    docs += [(900, None), (901, ""), (902, "Two, WORDS")]
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    do = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    got = {(r.item_id, r.doc_id): r.matched for r in leakage.proximity(it, do).collect()}
    want = brute_spans(items, docs, 0.8, 8)
    assert got == want and (53, 902) in got and len(want) > 50
    assert leakage.proximity(it.limit(0), do).count() == leakage.proximity(it, do.limit(0)).count() == 0


def test_forms_and_pairs(spark):
    base = "The opera begins in Café Zürich"
    seen = {1: base, 2: base.replace("o", "ο").replace("e", "е"), 3: "Ｔｈｅ opera begins in Café Zürich", 4: "The op​era be­gins in Café Zürich", 5: base, 6: base.lower(), 7: base.replace("é", "e"), 8: base.replace(" in ", "\nin "), 9: "москва о", 10: "", 11: None, 12: "​", 13: base * 500}
    df = spark.createDataFrame([(k, t, "x") for k, t in seen.items()], "doc_id long, text string, form string")
    forms = {r.doc_id: r.form for r in lookalikes.form(df, "text").collect()}
    assert {forms[i] for i in (1, 2, 3, 4, 5)} == {base}
    assert forms[6] != base and forms[7] != base and forms[8] != base and forms[9] == "москва o" and forms[10] == "" and forms[11] is None
    same = {(r.a, r.b) for r in lookalikes.pairs(df, "doc_id", "text").collect()}
    assert same == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (2, 5), (3, 5), (4, 5)}
    assert lookalikes.pairs(df.limit(0), "doc_id", "text").count() == 0


def test_groups_of_variants(spark):
    texts = ["plain tea"] * 300 + ["рlain tea", "plаin tea", "plаin tea", "other", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    got = {r.doc_id: (r.copies, r.links) for r in lookalikes.groups(df, "doc_id", "text").collect()}
    assert got == {**{i: (300, 3) for i in range(300)}, 300: (1, 302), 301: (2, 301), 302: (2, 301)}
    assert lookalikes.groups(df.limit(0), "doc_id", "text").count() == 0


def test_capitals_of_more_scripts(spark):
    df = spark.createDataFrame([(1, "ᎪΡΡⅬE PIE and TEA"), (2, "APPLE PIE and TEA"), (3, "ꓮꓑꓑꓡꓰ PIE and TEA"), (4, "ᎣᏏᏲ"), (5, "APPLE PIE and TEA said so")], "doc_id long, text string")
    forms = {r.doc_id: r.form for r in lookalikes.form(df, "text").collect()}
    assert forms[1] == forms[2] == forms[3] == "APPLE PIE and TEA" and forms[4] == "ᎣᏏᏲ"


def test_scripts_and_letters_narrow_languages():
    assert languages.candidates("straße") == ("de",) and languages.candidates("mañana") == ("es",) and languages.candidates("não") == ("pt",) and languages.candidates("cœur") == ("fr",)
    assert languages.candidates("été") == ("es", "fr", "pt")
    assert languages.candidates("the") == languages.LANGUAGES and languages.candidates("łódź") == languages.LANGUAGES
    assert languages.candidates("мир") == languages.candidates("世界") == languages.candidates("миr") == ()


def test_hot_group_stays_linear(spark):
    texts = ["plain tea"] * 300 + ["рlain tea", "plаin tea"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.a, r.b) for r in lookalikes.pairs(df, "doc_id", "text", expand=4).collect()}
    assert {x for p in got for x in p} == set(range(302)) and (300, 301) in got and len(got) < 700


def shingle_set(title, body):
    w = re.findall(r"[^\W_]+", re.sub("<[^>]*>", " ", f"{title or ''} {body or ''}").lower())
    return frozenset(zip(w, w[1:])) if len(w) >= 20 else None


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    data = []
    for i in range(0, 400, 2):
        w = [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(900)}" for _ in range(rng.randrange(18, 90))]
        data.append((i, "t", " ".join(w)))
        v = list(w)
        for _ in range(rng.randrange(0, len(w) // 3)):
            v[rng.randrange(len(v))] = rng.choice(common)
        cut = rng.randrange(len(v) // 2 + 1) if rng.random() < 0.4 else 0
        data.append((i + 1, "t", "<p>" + " ".join(v[cut:]).upper() + "</p>"))
    data += [(1000, None, None), (1001, "", "a " * 60), (1002, "A", "a " * 59), (1003, "one", "two"), (1004, "", " ".join(f"u{i}" for i in range(30_000)))]
    data.append(data[0])
    sets = {i: s for i, t, b in data if (s := shingle_set(t, b))}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(*r, 1) for r in data], "id long, title string, description string, class_id int")
    got = {(r.a, r.b) for r in neardup.pairs(df, "id", "title", "description", rare=3, groups=3).collect()}
    assert got == want and len(want) > 50
    grouped = {r.id: r.group_id for r in neardup.groups(df, "id", "title", "description", rare=3, groups=3).collect()}
    assert all(grouped[a] == grouped[b] for a, b in want) and set(grouped) == {x for p in want for x in p}
    assert neardup.pairs(df.limit(0), "id", "title", "description").count() == 0


def test_shared_lines_in_ten_thousand_records(spark):
    """Every signature of the shared lines is in thousands of records; small blocks find the same pairs."""
    rng = random.Random(6)
    lines = [" ".join(f"line{k}w{i}" for i in range(14)) for k in range(2)]
    data = [f"{lines[i % 2]} " + " ".join(f"r{rng.randrange(4000)}" for _ in range(rng.randrange(8, 13))) for i in range(9_600)]
    for i in range(400):
        w = rng.choice(data[:9_600]).split()
        w[rng.randrange(14, len(w))] = f"edited{i}"
        data.append(" ".join(w))
    sets = [shingle_set("", t) for t in data]
    where = {}
    for i, x in enumerate(sets):
        for g in x:
            if not g[1].startswith("line"):
                where.setdefault(g, []).append(i)
    tried = {(i, j) for ids in where.values() for i in ids for j in ids if i < j}
    # the 13 shingles of a line alone are too few, since every set has 21 or more
    want = {(i, j) for i, j in tried if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(data)], "id long, title string, description string")
    for crowd in (300, 10**9):
        links, members = neardup.links(df, "id", "title", "description", crowd=crowd)
        of = {r.class_id: r.id for r in members.collect()}
        got = {(min(p), max(p)) for r in links.collect() for p in [(of[r.a], of[r.b])]}
        assert got == want and len(want) > 300


def test_parts_in_rounds(spark, monkeypatch):
    """Many parts give the pairs of few, in rounds that leave no shuffle files behind."""
    rng = random.Random(8)
    data = [(i, "", " ".join(f"r{rng.randrange(300)}" for _ in range(30))) for i in range(150)]
    data += [(1000 + i, "", t.replace("r7", "s7")) for i, _, t in data]
    df = spark.createDataFrame(data, "id long, title string, description string")
    status = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    labels, keep = [], neardup.store

    def store(x, label, **options):
        before = status().size()
        out = keep(x, label, **options)
        labels.append((label, status().size() - before))
        return out

    monkeypatch.setattr(neardup, "store", store)
    few = rows(neardup.pairs(df, "id", "title", "description", rare=3, groups=3))
    assert [x for x, _ in labels].count("met") == 1
    monkeypatch.setattr(neardup, "PART_SHINGLES", 150)
    many = rows(neardup.pairs(df, "id", "title", "description", rare=3, groups=3))
    assert many == few and len(few) >= 150 and [x for x, _ in labels].count("met") == 1 + neardup.ROUNDS
    assert all(left <= 0 for _, left in labels)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_bitmaps_never_exclude():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 150)).astype(np.uint32)) for _ in range(2))
        maps = neardup_kernel.parity_bits(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[a, b], 2)
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(a, b))


def test_copies_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, "", text) for i in range(200)] + [(500, "", text + " more")], "id long, title string, description string")
    got = rows(neardup.pairs(df, "id", "title", "description", expand=4))
    assert {x for p in got for x in p} == {*range(200), 500} and len(got) < 450


def test_long_chains_are_one_group(spark):
    rng = random.Random(9)
    edges, want = [], {}
    for size in (2, 3, 60, 1500):
        ids = rng.sample(range(len(want) * 10**6, len(want) * 10**6 + 10**5), size)
        edges += list(zip(ids, ids[1:], strict=False))
        want |= dict.fromkeys(ids, min(ids))
    df = spark.createDataFrame(edges + edges[:5] + [(b, a) for a, b in edges[:9]], "a long, b long")
    assert rows(neardup.components(df)) == sorted(want.items(), key=str)
    assert neardup.components(df.limit(0)).count() == 0


def test_successive_versions_are_one_group(spark):
    words = [f"w{i}" for i in range(900)]
    order = random.Random(2).sample(range(120), 120)
    df = spark.createDataFrame([(order[i], "", " ".join(words[7 * i : 7 * i + 30])) for i in range(120)], "id long, title string, description string")
    grouped = neardup.groups(df, "id", "title", "description").collect()
    assert len(grouped) == 120 and len({r.group_id for r in grouped}) == 1


def test_variants_of_one_set_are_all_paired(spark):
    base = [f"w{i}" for i in range(40)]
    variants = [" ".join(w.upper() if i == k else w for i, w in enumerate(base)) for k in range(30)]
    near = [" ".join(base) + f" more{k}" for k in range(3)]
    texts = variants + near + [variants[3]] * 9
    df = spark.createDataFrame([(i, None if i % 2 else "", t) for i, t in enumerate(texts)], "id long, title string, description string")
    got = {(r.a, r.b) for r in neardup.pairs(df, "id", "title", "description", expand=4).collect()}
    copies = [i for i, t in enumerate(texts) if t == variants[3]]
    left_out = {(a, b) for a in copies[1:] for b in copies[4:] if a < b}
    assert got == {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))} - left_out
