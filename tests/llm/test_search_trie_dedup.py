"""op11 to op13: brute force, SQL, odd rows, hot groups over many partitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from ctxloom.llm import exact_dedup, lexical_search, prefix_trie, queries
from ctxloom.llm.ordered import ahead_of
from tests.test_queries import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert rows(queries.queries()[name](spark, FOLDER).toArrow()) == rows(con.execute(queries.oracle_sql()[name]).to_arrow_table())


# op11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top):
    lists = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(lists), sum(n for _, _, n in lists)
    df = Counter(t for _, c, _ in lists for t in c)
    out = []
    for key in dict.fromkeys(i for i, _ in items):
        query = [t for text in dict.fromkeys(t for i, t in items if i == key and t is not None) for t in terms(text)]
        found = []
        for doc, c, n in lists:
            m = 75 + 25 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in query if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(key, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


ODD = [(1, None), (2, ""), (3, "\n \t"), (4, "Straße straße STRASSE naïve"), (5, "a a a b"), (5, "a a a b"), (None, "a b"), (None, "ÉTÉ été Été"), (6, "x y \u0085z a-b_c"), (7, "a" * 70_000 + " a " * 30_000), (-8, "日本 語 a1 1a"), (9, "a\0b")]
ITEMS = [(1, "A b"), (1, "A b"), (2, None), (3, "  "), (4, "straße été x y"), (None, "b 日本"), (5, "a"), (5, "c b"), (6, "absent"), (7, "a a a a b")]


def searched(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, term string, score long").repartition(parts)
    b = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, rank string")
    return sorted(map(tuple, lexical_search.search(d, b, **more).collect()), key=repr)


def test_search_of_odd_rows(spark):
    expected = ranked(ODD, ITEMS, 20)
    assert searched(spark, ODD, ITEMS) == expected and expected
    assert searched(spark, ODD, ITEMS, items_per_pass=2) == expected
    assert searched(spark, ODD, ITEMS, bytes_per_pass=8) == expected
    assert searched(spark, [], ITEMS) == searched(spark, ODD, []) == searched(spark, ODD, [(1, None)]) == []


def test_search_keeps_the_best_of_many_copies(spark):
    docs = [(i, "same old words") for i in range(1000, 0, -1)] + [(i, f"same other w{i}") for i in range(2000, 2300)]
    items = [(1, "same words"), (2, "old w2100"), (3, "other")]
    assert searched(spark, docs, items, parts=7, top=5) == ranked(docs, items, 5)


def test_scores_are_exact_beyond_doubles():
    items = lexical_search.Items.of([(1, ["a b " * 50]), (2, ["b"])])
    weights = lexical_search.Weights(1000, 5000, lexical_search.np.array([29_999, 31_337]))
    texts = pa.array(["a a b", "", "b b b c", None])
    blocks = [[b.tolist() for _, b in lexical_search.scores(items, weights, texts, most)] for most in (lexical_search.EXACT, 1)]
    assert blocks[0] == blocks[1] and blocks[0][0][1] == [0, 0] and min(blocks[0][0][0]) > 0


def test_matches_are_whole_terms():
    items = lexical_search.Items.of([(1, ["he she hers é"])])
    n, doc, term, times = items.counts(pa.array(["ushers she,he HERS hers", "é É eé"]))
    assert n.tolist() == [5, 3]
    assert {(d, items.words[t].encode("latin-1").decode(), k) for d, t, k in zip(doc, term, times, strict=True)} == {(0, "she", 1), (0, "he", 1), (0, "hers", 2), (1, "é", 1)}


# op12


def built(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    return paths


def nodes_of(turns):
    members = defaultdict(list)
    paths = built(turns)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def tried(spark, tmp_path, turns, parts=5):
    df = spark.createDataFrame([(*t, "k", 1) for t in turns], "conv_id long, turn long, role string, text string, z1 string, depth long")
    df.repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op12_prefix_trie(spark, str(tmp_path)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, out.collect()), key=repr)


def test_trie_of_odd_rows(spark, tmp_path):
    turns = [(0, 0, "user", "hi"), (0, None, None, None), (0, 2, "a", "ä😀"), (0, 2, "a", "tie"), (0, 2, "a", "tie"), (1, 0, "user", "hi"), (None, 3, "x", "y"), (-5, 1, "", "x"), (-105, 1, "", "x"), (250, 7, "user", None), (251, 7, "user", "long " * 30_000), (252, 7, "user", None)]
    turns += [(300, i, "u", f"t{i % 3}") for i in range(45)] + [(c, i, "u", f"t{i % 3}") for c in (301, 302, 303) for i in range(c % 300 * 8)]
    assert tried(spark, tmp_path, turns) == nodes_of(turns)


def test_trie_of_random_conversations(spark, tmp_path):
    pick = random.Random(5)
    turns = [(c, i, pick.choice("ua"), "w" * pick.randrange(3)) for c in range(220) for i in range(pick.randrange(1, 20))]
    assert tried(spark, tmp_path, turns) == nodes_of(turns)


def test_trie_of_hot_conversations(spark, tmp_path):
    turns = [(c, i, "u", f"same {i}") for c in range(400) for i in range(3)]  # one path for all
    turns += [(1000, i, "u", f"t{i}") for i in range(150)] + [(1050, i, "u", f"t{i}") for i in range(140)]  # two long ones, shared until the end
    turns += [(c, i, "u", f"first{c * i}") for c in range(5000, 5300) for i in range(2)]  # very many children
    assert tried(spark, tmp_path, turns, 9) == nodes_of(turns)


def test_trie_of_no_conversation(spark, tmp_path):
    assert tried(spark, tmp_path, [], 1) == []
    assert tried(spark, tmp_path / "null", [(None, 1, "u", "x")], 1) == []


def test_running_figures_over_spans(spark):
    pick = random.Random(3)
    table = [(g, i, pick.randrange(-50, 50)) for g in (1, 2) for i in range(100)]
    out = ahead_of(spark.createDataFrame(table, "g long, i long, v long"), ["g"], "i", {"s": ("v", "sum"), "x": ("v", "xor")}, span=7).collect()
    for g in (1, 2):
        total = other = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["i"]):
            assert (r["s"], r["x"]) == (total, other)
            total, other = total + r["v"], other ^ r["v"]


# op13


def dedup(docs, keep):
    groups = defaultdict(list)
    for i, text in docs:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), text or "")].append(i)
    out = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(real) if real else None
        kept = False
        for i in sorted(ids, key=lambda x: x != best):
            out.append((i, best, len(ids), i == best and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = kept or i == best
    return sorted(out, key=repr)


def frame(spark, docs, parts):
    return spark.createDataFrame([(*d, n, "k", 1) for n, d in enumerate(docs)], "doc_id long, text string, row long, _key string, part long").repartition(parts)


HOT = [(None if i % 3 == 0 else i, "One Hot text" if i % 2 else "one hot TEXT") for i in range(600)] + [(None, "nothing else")] * 200
LONG = [(i, "Same start " * 40_000 + str(i % 2)) for i in range(6)]
DOCS = [(1, None), (2, ""), (2, ""), (3, "A"), (4, "a"), (5, "Ä"), (6, "ä"), (7, "a "), (None, None), (8, "İ"), (9, "a\0")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 7])
def test_dedup_of_odd_rows_and_hot_groups(spark, keep, parts):
    docs = DOCS + HOT + LONG
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # the hot groups fill several
    try:
        out = sorted(map(tuple, exact_dedup.groups(frame(spark, docs, parts), keep=keep).collect()), key=repr)
        assert out == dedup(docs, keep)
        kept = exact_dedup.keep_one(frame(spark, docs, parts), keep=keep)
        assert kept.columns == ["doc_id", "text", "row", "_key", "part"]
        got = kept.collect()
        assert all(docs[r["row"]] == (r["doc_id"], r["text"]) for r in got)
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in out if r[3])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dedup_of_an_empty_table_and_a_wrong_choice(spark):
    assert exact_dedup.groups(frame(spark, [], 1)).count() == 0 == exact_dedup.keep_one(frame(spark, [], 1)).count()
    with pytest.raises(ValueError, match="keep"):
        exact_dedup.groups(frame(spark, DOCS, 1), keep="first")
