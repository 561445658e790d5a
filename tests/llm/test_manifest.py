import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from storyloom.llm import manifest
from storyloom.llm.queries import op13_merkle_manifest

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = {i: i + 32 for i in range(65, 91)}
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree(leaves):
    """The last node, and for each leaf the runs and places on its way to it."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            ways[k].append((i % 16, runs[i // 16]))
        at, nodes = [i // 16 for i in at], [H(*r) for r in runs]
    return nodes[0], ways


def plain(rows, altered):
    """Every row's (id, leaf, subroot, root, proof, folded root), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for s in order}
    subs = {s: tree([leaf_of(r) for r in held[s]]) for s in order}
    root, high = tree([subs[s][0] for s in order])
    out = []
    for s, up in zip(order, high, strict=True):
        for r, low in zip(held[s], subs[s][1], strict=True):
            now = leaf_of({**r, "text": r["text"] and r["text"].translate(UPPER)} if altered(r) else r)
            for place, run in low + up:
                now = H(*run[:place], now, *run[place + 1 :])
            proof = H(*[x for place, run in low + up for i, x in enumerate(run) if i != place])
            out.append((str(r["doc_id"]), leaf_of(r), subs[s][0], root, proof, now))
    return sorted(out)


def told(found):
    folded = manifest.folded(F.coalesce("other", "digest"), F.col("steps"))
    rows = found.select("id", "digest", "subroot", "root", F.sha2(manifest.proof(F.col("steps")), 256).alias("proof"), folded.alias("folded")).collect()
    return sorted((str(r["id"]), *r[1:]) for r in rows)


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (17, 1), (700, 40)])
def test_against_a_plain_tree(spark, docs_of, n, sources):
    rng = random.Random(n)
    names = [None, "", "ü", "z", *(f"s{i}" for i in range(sources))][-sources:] if sources > 2 else [None]
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "Text É ", "x" * 99_999, f"T{i}"]), rng.choice([None, "en"]), rng.choice(names + names[:1] * len(names))) for i in range(n)]
    docs = docs_of(rows + rows[:3]).withColumns({"digest": F.lit(1), "idx": F.lit("clash")})
    hit = F.col("doc_id") % 3 == 0
    found = manifest.manifest(docs.repartition(5), FIELDS, altered={"text": F.translate("text", "".join(map(chr, UPPER)), "".join(map(chr, UPPER.values())))}, when=hit)
    assert told(found) == plain([r.asDict() for r in docs.collect()], lambda r: r["doc_id"] is not None and r["doc_id"] % 3 == 0)


def test_what_does_not_fit_the_root_is_found(spark, docs_of):
    docs = docs_of([(i, f"text {i}", None, "ab"[i % 2]) for i in range(100)])
    found = manifest.manifest(docs, FIELDS)
    other = manifest.digest(*[manifest.field(F.lit(x)) for x in ("5", "b", None, "6", "Text 5")])
    wrong = found.where(manifest.folded(F.when(F.col("id") == 5, other).otherwise(F.col("digest")), F.col("steps")) != F.col("root")).collect()
    assert [r["id"] for r in wrong] == [5]


def test_empty(spark, docs_of):
    assert manifest.manifest(docs_of([]), FIELDS).count() == 0


def test_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows, lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    got = op13_merkle_manifest(spark, SF).collect()
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got) == want
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and not all(r["verified"] for r in got)
