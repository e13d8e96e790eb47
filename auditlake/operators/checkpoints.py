"""Signed checkpoints of trees' sizes and roots, and what they prove later."""

from __future__ import annotations

import json
from collections.abc import Callable

from auditlake.functions.keys import RsaRing
from auditlake.operators.integrity import Tree, verify_consistency


def _message(made: dict) -> bytes:
    return json.dumps({k: v for k, v in made.items() if k not in ("signature", "anchor_error")}, sort_keys=True).encode()


def signed(record: dict, keys: RsaRing) -> dict:
    """The record with the key version and a signature over all of it."""
    made = record | {"key_version": keys.active}
    return made | {"signature": keys.sign(_message(made))[1].hex()}


def holds(record: dict, keys: RsaRing) -> bool:
    """Whether a record's signature is one of its key version over what it says."""
    return keys.verify(record["key_version"], _message(record), bytes.fromhex(record["signature"]))


def checkpoint(tree: Tree, keys: RsaRing, created_at: int, anchor: Callable[[dict], None] | None = None) -> dict:
    """Size, root and signature of the tree now; `anchor` gets a copy, and its errors do not undo the checkpoint."""
    made = signed({"created_at": created_at, "size": tree.size, "root": tree.root().hex()}, keys)
    if anchor:
        try:
            anchor(dict(made))
        except Exception as e:  # noqa: BLE001  an anchor is someone else's code
            made["anchor_error"] = str(e)
    return made


def problems(tree: Tree, checkpoints: list[dict], keys: RsaRing) -> list[str]:
    """What the checkpoints show against the tree now: bad signatures, a smaller tree, or another history."""
    out = [f"checkpoint {i}: bad signature" for i, c in enumerate(checkpoints) if not holds(c, keys)]
    if not checkpoints:
        return out
    last = checkpoints[-1]
    if tree.size < last["size"]:
        return [*out, f"the tree shrank from {last['size']} to {tree.size}"]
    if not verify_consistency(last["size"], tree.size, tree.consistency(last["size"]), bytes.fromhex(last["root"]), tree.root()):
        out.append("the last checkpoint is no prefix of the tree")
    return out


def global_checkpoint(shards: dict[int, tuple[int, bytes]], manifest: str, keys: RsaRing, created_at: int) -> dict:
    """One signed record of all shards' sizes and roots and of the ring they belong to."""
    return signed({"created_at": created_at, "manifest": manifest, "shards": {str(s): [n, root.hex()] for s, (n, root) in sorted(shards.items())}}, keys)


def global_problems(made: dict, shards: dict[int, tuple[int, bytes]], manifest: str, keys: RsaRing) -> list[str]:
    """What a global checkpoint shows against the shards now. Growth is no problem; `problems` proves it per shard."""
    out = [] if holds(made, keys) else ["bad signature"]
    if made["manifest"] != manifest:
        out.append("the ring changed")
    for s, (size, root) in made["shards"].items():
        now = shards.get(int(s))
        if now is None:
            out.append(f"shard {s}: missing")
        elif now[0] < size:
            out.append(f"shard {s}: rollback")
        elif now[0] == size and now[1].hex() != root:
            out.append(f"shard {s}: rewrite")
    return out
