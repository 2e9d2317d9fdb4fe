import hashlib
import zlib

import pytest

from jobweave.llm import merkle, ordering

from .helpers import DOCS, edge_rows, table


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes):
    """(root, proof of each hash) by plain lists."""
    proofs, nodes, at = [[] for _ in hashes], hashes, list(range(len(hashes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // 3 * 3
            proofs[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + 3])))
            at[i] = k // 3
        nodes = [h(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute(rows):
    leaves = {}
    for doc_id, text, lang, source, n_chars in rows:
        seen = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        own = [h(*map(field, (doc_id, source, lang, n_chars, t))) for t in (text, seen)]
        leaves.setdefault(source, []).append((doc_id is not None, doc_id or 0, *own, doc_id))
    groups = [(source, sorted(leaves[source], key=lambda x: x[:3])) for source in sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))]
    climbed = [climb([x[2] for x in own]) for _, own in groups]
    root, over = climb([r for r, _ in climbed])
    out = []
    for (_, own), (subroot, proofs), rest in zip(groups, climbed, over, strict=True):
        for x, proof in zip(own, proofs, strict=True):
            folded = x[3]
            for left, right in proof + rest:
                folded = h(left, folded, right)
            out.append((x[4], x[2], subroot, root, h(*[a + b for a, b in proof + rest]), folded, folded == root))
    return sorted(out, key=repr)


def manifest(spark, rows):
    got = merkle.without_line_ends(spark.createDataFrame(rows, DOCS).repartition(3))
    return sorted(map(tuple, got.collect()), key=repr)


def test_brute_force_on_awkward_rows(spark):
    assert manifest(spark, edge_rows()) == brute(edge_rows())


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1], [28, 9, 1, 2], [1] * 11, [82, 1, 27]])
def test_shapes_of_trees(spark, sizes):
    rows = [(g * 1000 + i, f"t\n{i}", "en", f"é{g}" if g else None, i) for g, n in enumerate(sizes) for i in range(n)]
    assert manifest(spark, rows) == brute(rows)


def test_table(spark):
    rows = [tuple(None if v != v else v for v in r) for r in table("documents")[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False, name=None)]
    assert manifest(spark, rows) == brute(rows)


def test_positions(spark):
    df = spark.range(5000).selectExpr("id * 37 % 5000 as k").repartition(7)
    assert all(r.k == r.position for r in ordering.numbered(df, "k").collect())
    assert ordering.numbered(df.limit(0), "k").count() == 0
