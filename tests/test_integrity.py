import hashlib

import pytest

from auditlake.functions.scalars import node_hash
from auditlake.operators.integrity import EMPTY, block_roots, broken_leaves, consistency_path, fold, inclusion_path, merkle_root, new_nodes, Tree, verify_consistency, verify_global, verify_inclusion


def leaf(i):
    return hashlib.sha256(b"\0" + f"rec-{i}".encode()).digest()


def tree(hashes):
    """The recursive definition."""
    if not hashes:
        return EMPTY
    if len(hashes) == 1:
        return hashes[0]
    k = 1 << ((len(hashes) - 1).bit_length() - 1)
    return node_hash(tree(hashes[:k]), tree(hashes[k:]))


def node(leaves, height, idx):
    return tree(leaves[idx << height : (idx + 1) << height])


def test_fold_equals_recursion():
    for n in range(0, 301):
        hashes = [leaf(i) for i in range(n)]
        assert fold(hashes) == tree(hashes)


def test_every_proof():
    for n in range(1, 131, 3):
        leaves = [leaf(i) for i in range(n)]
        root = tree(leaves)
        for i in range(n):
            proof = [node(leaves, h, k) for h, k in inclusion_path(i, n)]
            assert verify_inclusion(leaves[i], i, n, proof, root)
            assert not verify_inclusion(leaves[i], i, n, proof, EMPTY) and not verify_inclusion(leaves[i], i, n, [*proof, root], root)
        for m in range(n + 1):
            proof = [node(leaves, h, k) for h, k in consistency_path(m, n)]
            assert verify_consistency(m, n, proof, tree(leaves[:m]), root), (m, n)
            if 0 < m < n:
                assert not verify_consistency(m, n, proof, leaf(999), root)
    with pytest.raises(IndexError):
        inclusion_path(3, 3)


def frame(spark, n):
    return spark.createDataFrame([(i, bytearray(leaf(i))) for i in range(n)], "idx long, hash binary")


def test_distributed_root_and_nodes(spark):
    leaves = [leaf(i) for i in range(1000)]
    for n in (1, 2, 7, 64, 65, 1000):
        assert bytes(merkle_root(frame(spark, n), n, height=3).first().hash) == tree(leaves[:n])
    assert bytes(merkle_root(frame(spark, 0), 0).first().hash) == EMPTY
    assert block_roots(frame(spark, 20), 3).count() == 3


def test_stored_nodes_answer_proofs_as_the_tree_grows(spark):
    leaves = [leaf(i) for i in range(1000)]
    nodes, old = spark.createDataFrame([], "height int, idx long, hash binary"), 0
    for n in (5, 8, 70, 71, 600, 1000):
        made = new_nodes(frame(spark, n), nodes, old, n, height=3)
        if made is not None:
            nodes = spark.createDataFrame(nodes.unionByName(made).collect(), "height int, idx long, hash binary")
        old = n
        at = Tree(frame(spark, n), nodes, n, height=3)
        assert at.root() == tree(leaves[:n])
    assert {(r.height, r.idx): bytes(r.hash) for r in nodes.collect()} == {(h, i): node(leaves, h, i) for h in (3, 6, 9) for i in range(1000 >> h)}
    assert at.inclusion(777) == [node(leaves, h, k) for h, k in inclusion_path(777, 1000)]
    assert at.consistency(600) == [node(leaves, h, k) for h, k in consistency_path(600, 1000)]
    assert at.rows(inclusion_path(777, 1000)).count() < 80 and Tree(frame(spark, 0), nodes, 0).root() == EMPTY


def test_changed_records_and_checkpoints(spark):
    assert broken_leaves(frame(spark, 10).where("idx > 3"), frame(spark, 10)).count() == 0
    bad = frame(spark, 10).selectExpr("idx", "if(idx = 4, unhex('00'), hash) as hash")
    assert [r.idx for r in broken_leaves(bad, frame(spark, 9)).orderBy("idx").collect()] == [4, 9]
    then = spark.createDataFrame([(0, 5, "a"), (1, 5, "b"), (2, 5, "c"), (3, 5, "d")], "shard int, size long, root string")
    now = spark.createDataFrame([(0, 6, "x"), (1, 5, "x"), (2, 4, "c")], "shard int, size long, root string")
    assert sorted(map(tuple, verify_global(now, then).collect())) == [(1, "rewrite"), (2, "rollback"), (3, "missing")]
