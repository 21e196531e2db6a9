"""The Merkle manifest by a plain second version."""

import zlib
from hashlib import sha256

import pytest
from plumbgrid.llm import manifest
from samples import SCHEMA


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    d, text, lang, source, n = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def climbed(digests):
    """Root of a list of digests, and each one's siblings by level: (left, right)."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            paths[k].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        level, at = [h("".join(r)) for r in runs], [i // 16 for i in at]
    return level[0], paths


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    made = {s: climbed([leaf(r) for r in g]) for s, g in groups.items()}
    root, over = climbed([made[s][0] for s in sources])
    out = []
    for s, up in zip(sources, over):
        for r, path in zip(groups[s], made[s][1]):
            found = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                found = leaf((r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:]))
            for left, right in path + up:
                found = h(left + found + right)
            out.append((r[0], leaf(r), made[s][0], root, h("".join(a + b for a, b in path + up)), found, found == root))
    return out


def order(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 16, None: 1}, {"a": 17, "b": 256, "Z": 257},
                                   {"hot": 5000, None: 300, "é": 33, "": 2}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_trees_of_all_sizes(spark, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for i in range(n):
            k += 1
            rows.append((k * 7919 % 100_003, f"Text {k} É" if i % 5 else None, "x" if i % 3 else None, source, k if i % 4 else None))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in manifest.manifest(docs).collect()]
    assert sorted(got, key=order) == sorted(plain(rows) if rows else [], key=order)


def test_awkward_rows(docs, rows):
    got = manifest.manifest(docs.withColumnRenamed("rep", "_at")).collect()
    assert sorted(map(tuple, got), key=order) == sorted(plain(rows), key=order)
    changed = {r.doc_id for r in got if not r.verified}
    texts = {r[0]: r[1] for r in rows}
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 and texts[d] != texts[d].lower() for d in changed)
    assert all(r.verified for r in manifest.manifest(docs, tampered=False).collect())
