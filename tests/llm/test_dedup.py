import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pelagos.llm.components import components
from pelagos.llm.exact_dedup import CuckooIndex, _meet, _task, digests, drop_duplicates, duplicates, live_index
from pelagos.llm.simhash import band_plan, bands, drop_near_duplicates, fingerprint, links, masks, near_duplicates, shingles, similarity
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(prints, np.uint64)
    for a in range(len(ids)):
        for b in np.nonzero(np.bitwise_count(f[a] ^ f[a + 1 :]) <= radius)[0]:
            x, y = find(a), find(a + 1 + int(b))
            parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_fingerprints_agree_with_the_definition():
    for text in cases.texts():
        assert fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_near_duplicates_agree_with_all_pairs(spark):
    rows = cases.rows()
    prints = [slow_fingerprint(r[1]) for r in rows]
    wanted = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, classes([r[0] for r in rows], prints)))
    assert Counter(map(tuple, near_duplicates(cases.table(spark)).collect())) == wanted
    assert near_duplicates(cases.empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = cases.rows()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [frozenset(shingles((r[1] or "").encode())) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    wanted = Counter(tuple(r) for i, r in enumerate(rows) if r[0] == min(least[find(i)], default=None))
    found = drop_near_duplicates(cases.table(spark))
    assert found.columns == cases.table(spark).columns
    assert Counter(map(tuple, found.collect())) == wanted
    assert drop_near_duplicates(cases.empty(spark)).count() == 0


def test_bands_agree_with_the_definition():
    for text in cases.texts()[:40]:
        data = (text or "").encode()
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(data)]
        mixed = []
        for k in range(3):
            word = []
            for x in h:
                x = (x + (64 * k + 1) * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
                word.append((x ^ (x >> 31)).to_bytes(8, "little"))
            for at in range(64):
                mixed.append(2 * sum(w[at // 8] >> (7 - at % 8) & 1 for w in word) > len(h))
        wanted = [sum(bool(b) << i for i, b in enumerate(mixed[28 * n : 28 * n + 28])) + (n << 28) for n in range(6)]
        assert bands(data, 5, 28, 6).tolist() == wanted


def test_texts_at_the_threshold_meet():
    bits, number = band_plan(200_000, 0.8)
    assert (bits, number) == (28, 15)
    rng, hit = np.random.default_rng(2), 0
    for _ in range(300):
        words = [b"%d" % x for x in rng.integers(0, 10**6, 404)]
        near = list(words)
        for at in range(10, 404, 45):  # 9 words: 355 of 445 shingles are shared
            near[at] = b"x%d" % rng.integers(10**6)
        a, b = bands(b" ".join(words), 5, bits, number), bands(b" ".join(near), 5, bits, number)
        hit += (np.bitwise_count(a ^ b) <= 2).any()
    assert hit >= 0.9 * 300


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_connect_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    more = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for x in f for _ in range(3)]
    every = sorted({int(x) for x in f} | set(more))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in every], "fp long")
    found = {tuple(r) for r in components(links(df, radius), "a", "b").collect()}
    root = dict(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    label = classes(signed, every, radius)
    groups = defaultdict(set)
    for s, c in zip(signed, label):
        groups[c].add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({root.get(s, s) for s in signed})
    assert len(masks(2)) == 65


def test_odd_radius_is_refused():
    with pytest.raises(ValueError):
        masks(3)


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()))
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_duplicates_agree_with_the_definition(spark):
    rows = cases.rows()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    wanted = Counter((r[0], keep[normal(r[1])], len(groups[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in rows)
    found = duplicates(cases.table(spark)).collect()
    assert Counter((r[0], r[1], r[2], r[4]) for r in found) == wanted
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    assert Counter(r[4] for r in found if r["kept"]) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})
    assert duplicates(cases.empty(spark)).count() == 0


def test_of_equal_texts_one_row_stays(spark):
    rows = cases.rows()
    found = drop_duplicates(cases.table(spark))
    assert found.columns == cases.table(spark).columns
    kept = [tuple(r) for r in found.collect()]
    first = {}
    for r in rows:
        k = normal(r[1])
        if k not in first or (r[0] is not None and (first[k][0] is None or r[0] < first[k][0])):
            first[k] = r
    assert sorted(kept, key=str) == sorted(map(tuple, first.values()), key=str)
    assert drop_duplicates(cases.empty(spark)).count() == 0


def test_deleting_the_last_copy_takes_a_digest_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "doc_id long, text string")
    keys = digests(docs)
    gone = keys.where("id in (2, 3)").select("digest", "size")
    found = {(r["keep_id"], r["copies"]) for r in live_index(keys, gone).collect()}
    assert found == {(1, 1), (4, 1)}


def test_copies_meet_in_the_index_and_not_in_an_aggregate(spark):
    keys = digests(cases.table(spark))
    plan = live_index(keys)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("MapInArrow") == 2 and "Aggregate" not in plan
    small = {(r["digest"], r["keep_id"], r["copies"]) for r in live_index(keys, shard_keys=10, task_keys=3).collect()}
    assert small == {(r["digest"], r["keep_id"], r["copies"]) for r in live_index(keys).collect()}


def test_a_tasks_index_deletes_its_oldest_entries():
    schema = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("copies", pa.int64())])
    rng = random.Random(4)
    rows = [(hashlib.sha256(b"%d" % k).digest(), k, 100 - i, i) for i, k in enumerate(rng.choices(range(30), k=400))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["digest", "size", "id", "row"])
    out = [r for b in _task(iter([batch]), schema, 5) for r in zip(*(c.to_pylist() for c in b.columns))]
    total, least = Counter(), {}
    for digest, size, who, row, n in out:
        total[digest] += n
        least[digest] = min(least.get(digest, (who, row)), (who, row))
    assert total == Counter(r[0] for r in rows)
    assert all(least[d] == min((r[2], r[3]) for r in rows if r[0] == d) for d in least)
    assert len(_entries_of_last(out)) <= 5 < len(out) < 400  # some copies met, some were handed on
    index = CuckooIndex(2)
    for digest, size, who, row in rows:
        _meet(index, digest + size.to_bytes(8, "little"), who, row, 1)
    assert index.hits == 400 - 30 and index.resized > 0 and index.size == 30


def _entries_of_last(out):
    return {r[0] for r in out[-5:]}


def test_cuckoo_index_against_a_dict():
    rng = np.random.default_rng(5)
    index, live = CuckooIndex(2), {}
    digest = [hashlib.sha256(b"%d" % i).digest() for i in range(3000)]
    for step in range(20_000):
        d = digest[int(rng.integers(len(digest)))]
        if rng.random() < 0.6:
            if index.find(d) is None:
                assert d not in live
                index.insert(d, [step])
                live[d] = [step]
        else:
            assert index.delete(d) == (live.pop(d, None) is not None)
        if step % 500 == 0:
            assert all((index.find(x) is not None) == (x in live) for x in digest)
    assert dict(index.items()) == live
    assert index.resized > 0


def test_cuckoo_index_with_equal_tags_and_buckets():
    index = CuckooIndex(4)
    same = [bytes(8) + b"\x07\x00" + bytes([i, j]) + bytes(20) for i in range(3) for j in range(2)]
    for d in same:
        index.insert(d, [d])
    assert all(index.find(d) == [d] for d in same)
    assert index.find(bytes(8) + b"\x07\x00" + b"\xff" * 22) is None
    assert index.false_hits == 1


def test_similar_texts_are_dropped_by_the_pipeline(spark):
    import corpus_pipeline as cp

    rng = random.Random(11)
    rows = []
    for i in range(150):
        base = cases.words(rng, 300, 5000)
        rows.append((3 * i, " ".join(base)))
        for k in (1, 2):  # 5 or 9 words apart: 0.84 and 0.73 of the shingles, about
            near = list(base)
            for at in range(20, 20 + 30 * (5 if k == 1 else 9), 30):
                near[at] = "changed%d" % k
            rows.append((3 * i + k, " ".join(near)))
    rows += [(1000 + i, " ".join(["same"] * 40 + [f"x{i}"] + ["w%d" % (j % 97) for j in range(300)])) for i in range(400)]  # one large group
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (None, "one"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = lambda x, y: similarity((x or "").encode(), (y or "").encode()) >= 0.8
    for a in range(0, 450, 3):
        for x, y in ((a, a + 1), (a, a + 2), (a + 1, a + 2)):
            if near(rows[x][1], rows[y][1]):
                parent[find(y)] = find(x)
    for x in range(451, 850):
        if near(rows[450][1], rows[x][1]):
            parent[find(x)] = 450
    wanted = {rows[i][0] for i in range(850) if find(i) == i} | {5000, 5002}
    assert len(wanted) == 150 + 150 + 1 + 2  # the first change is near, the second is not
    found = [r[0] for r in cp.near(spark, docs, "").collect()]
    missed = {x for x in found if x is not None} - wanted  # pairs near the threshold that meet in no band
    assert wanted <= set(found) and len(missed) <= 0.05 * 150 and all(x < 450 for x in missed)
    assert found.count(None) == 1
    assert cp.near(spark, docs.limit(0), "").count() == 0
