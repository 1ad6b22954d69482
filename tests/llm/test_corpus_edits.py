"""Line dedup, mixing and sharding against plain loops, with nulls, ties, repeats and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from townhall.llm import lines, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "É", "c", None])
        k = rng.choice([0, 0, 1, 5, 20, 100, 2500])
        text = rng.choice([None, "", " \n"]) if k == 0 else rng.choice([" ", "\n", "\t "]).join(rng.choice(["x", "été", "long-word"]) for _ in range(k))
        rows.append((i, text, source, "clash"))
    rows += [rows[5], (None, "one two", "a", "clash"), (None, None, None, "clash")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)


def reshared(sizes):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            capped.add(s)
            left -= target[s]


def test_mixing(spark):
    rows = documents()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    goals = reshared(sizes)
    out = mixing.copies(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, goals[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in goals:
        assert abs(taken[s] - goals[s]) <= 2 * 2500
    again = mixing.copies(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_rows_are_the_planned_copies(spark):
    rows = documents(2, 120)
    df = frame(spark, rows)
    want = Counter()
    for r in mixing.copies(df).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mixing.mix(df).collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(df).columns == df.columns


def test_mixing_of_nothing(spark):
    df = frame(spark, documents())
    assert mixing.copies(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.copies) for r in mixing.copies(wordless).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_offsets_are_md5(spark):
    got = spark.range(1).select(mixing.unit_hash(F.lit("17/a")).alias("u")).first().u
    assert got == int(md5(b"17/a").hexdigest()[:8], 16) / 2**32


def test_line_dedup(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        body = [f"own {i} {k}" for k in range(rng.randrange(4))] + (["menu"] if rng.random() < 0.5 else []) + ["", "rare" if i in (3, 9) else " "]
        rng.shuffle(body)
        rows.append((i, rng.choice(["a", "a", "b", None]), "\n".join(body), 1))
    rows += [rows[0], (None, "a", "menu\nx", 1), (200, "a", None, 1), (201, "c", "menu", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n int").repartition(3)
    pages, holds = Counter(), Counter()
    for _, s, t, _ in rows:
        pages[s] += 1
        holds.update((s, x) for x in set((t or "").split("\n")) if x.strip(" "))
    common = {k for k, n in holds.items() if n >= 10 and n > 0.1 * pages[k[0]]}
    want = sorted((str(d), str(s), None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in common), n) for d, s, t, n in rows)
    out = lines.clean_documents(df, 0.1, 10)
    assert out.columns == df.columns
    assert sorted(((str(r.doc_id), str(r.source), r.text, r.n) for r in out.collect()), key=str) == sorted(want, key=str)
    assert lines.clean_documents(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(i, f"HTTP://Site.example:80/{i}", f"<p>menu</p><b>body {i}</b>\r\n<i> menu </i>") for i in range(20)] + [(99, None, None), (98, "no url", "<p>menu")]
    got = {r.page_id: r for r in lines.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[3].host, got[3].text, got[3].n_lines, got[3].n_removed) == ("site.example", "body 3", 3, 2)
    assert (got[99].n_lines, got[99].text, got[98].text) == (0, "", "menu")


def test_sharding(spark):
    rows = documents(4, 3000)
    out = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == want
    loads, slots = Counter(), defaultdict(list)
    for r in out:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(16))
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in out)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(frame(spark, rows).limit(0)).count() == 0


def test_sharding_without_ids(spark, tmp_path):
    """Null and repeated ids spread by their texts; the map's versions are stored."""
    rows = [(None, f"{i} " * 40, "s", "x") for i in range(4000)] + [(7, f"{i} " * 30, "s", "x") for i in range(4000)]
    maps = str(tmp_path / "maps")
    placed = sharding.shard_documents(frame(spark, rows), maps=maps)
    loads = Counter()
    for r in placed.collect():
        loads[r.shard] += r["size"]
    assert len(loads) == 16 and max(loads.values()) <= 1.05 * min(loads.values())
    assert sharding.SlotMap.load(spark, maps, 1).owner == sharding.SlotMap.even(16).owner
    last = sharding.SlotMap.load(spark, maps, 2)
    assert last.shards == 16 and {s: n for s, n in enumerate(last.loads())} == dict(loads)


def test_own_names_pass_through(spark):
    """Columns named as the operators' inner ones are neither lost nor changed."""
    names = ["_id", "_source", "_size", "_host", "_all", "_kept", "_copies", "row", "turn", "size", "hash", "n"]
    docs = spark.createDataFrame([(i, f"common\nline {i}", "s", *range(len(names))) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    for done in (lines.clean_documents(docs), mixing.mix(docs)):
        assert done.columns == docs.columns
        assert all(tuple(r)[3:] == tuple(range(len(names))) for r in done.collect())
    assert lines.clean_documents(docs).filter(F.col("text").startswith("common")).count() == 0


def test_empty_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p><p>y</p>")] * 3 + [(2, "http://a.b/c", "<p>x</p><p>z</p>")], "page_id long, url string, html string")
    got = Counter((r.page_id, r.text, r.n_lines, r.n_removed) for r in lines.clean_pages(pages).collect())
    assert got == {(1, "", 2, 2): 3, (2, "z", 2, 1): 1}
    assert lines.clean_pages(pages.limit(0)).count() == 0


def test_slot_map_edits(spark, tmp_path):
    rng = random.Random(5)
    first = sharding.SlotMap.even(4, 256).measured([(s, int(rng.paretovariate(1.1) * 10), 1) for s in range(256)])
    second = first.rebalanced()
    third = second.grown()
    assert (first.version, second.version, third.version, third.shards) == (1, 2, 3, 5)
    assert max(second.loads()) <= max(first.loads())
    assert all(a == b or b == 4 for a, b in zip(second.owner, third.owner))
    assert third.loads()[4] > 0.7 * sum(third.loads()) / 5
    for m in (first, second, third):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 2).owner == second.owner
