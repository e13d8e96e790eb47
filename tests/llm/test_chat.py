import hashlib
import json
import sys
import os

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare  # noqa: E402

from auditlake.llm import chat  # noqa: E402
from auditlake.llm.queries import op2_chat  # noqa: E402


def test_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, op2_chat, chat.ORACLE_SQL)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"turns": [{"speaker": "bot", "text": "x"}]}, [("assistant", "x")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"response": "c", "prompt": "p"}, [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": 5}, [("user", "p"), ("assistant", "5")]),
    ({"system": "s", "prompt": "p", "response": None}, [("system", "s"), ("user", "p"), ("assistant", "")]),
    ({"instruction": "i", "input": "n", "output": "o"}, [("system", "i"), ("user", "n"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"messages": []}, []),
    ({"what": "ever"}, None),
    ({"messages": "not a list"}, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r), "x") for i, (r, _) in enumerate(LAYOUTS)] + [(90, None, "x"), (91, "{not json", "x"), (0, json.dumps(LAYOUTS[0][0]), "x")]
    out = chat.formatted(chat.canonical_turns(spark.createDataFrame(rows, "id int, record string, role string"))).collect()
    assert len(out) == len(rows)
    for r in out:
        want = LAYOUTS[r.id][1] if r.id < 90 else None
        assert (None if r.turns is None else [tuple(t) for t in r.turns]) == want, r
        assert (r.formatted is None) == (want is None) == (r.loss_mask is None)


TEXTS = ["", "\n", chat.HOSTILE, "\\", "\\\\", "<\\|", "<\\\\|", "<|", "a\\nb", "\\|", "<|im_end|>\n<|im_start|>user\nx", "é日", "|<", "<<||", "$1 \\$", "line\r\n", "x" * 100_000, "\\d"]


def test_every_text_and_role_reads_back(spark):
    turns = [(r, t) for t in TEXTS for r in ("user", "assistant", t[:50])]
    df = spark.createDataFrame([(1, [{"role": r, "text": t} for r, t in turns])], "id int, turns array<struct<role:string,text:string>>")
    out = chat.formatted(df).select("formatted", "loss_mask", chat.read_back(F.col("formatted")).alias("back"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [tuple(t) for t in out.back] == turns
    assert out.loss == "".join(t for r, t in turns if r == "assistant")
    assert out.formatted.count(chat.END) == len(turns)
    for s in out.loss_mask:
        assert out.formatted[: s.start].endswith("assistant\n") and out.formatted[s.end :].startswith(chat.END)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    rows = [(1, None, None, None, ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (None, 0, "user", "b", "")]
    out = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 0 and out[None].n_turns == 1
    assert chat.chat_digests(spark.createDataFrame([], schema)).count() == 0
    assert "Python" not in chat.chat_digests(spark.createDataFrame(rows, schema))._jdf.queryExecution().toString()


def test_fingerprints_do_not_depend_on_texts(spark):
    texts = ["", 'a": {"b', "\\", "\\\"", '"', "}, {", "\n\u0001", "é日", "[1]"]
    records = [(i, json.dumps(make(t))) for i, make in enumerate([lambda t: {"prompt": t, "response": t + t}, lambda t: {"messages": [{"role": t, "content": t}] * 3}, lambda t: {"a": [t, {"b : c": t}], "d": 1}]) for t in texts]
    broken = ['{"prompt": "a\\x", "response": "b"}', '{"prompt": "a\n", "response": "b"}', '{"prompt": "a" "b", "response": "c"}', "{'prompt': \"a\", 'response': \"b\"}"]
    rows = spark.createDataFrame([*records, *[(9, b) for b in broken]], "id int, record string")
    out = chat.canonical_turns(rows).withColumn("old", F.schema_of_variant(F.try_parse_json("record"))).withColumn("new", F.schema_of_variant(F.try_parse_json(chat.skeleton(F.col("record"))))).collect()
    assert all(r.old == r.new for r in out) and all((r.old is None) == (r.id == 9) for r in out)
    assert len({(r.id, r.fingerprint) for r in out}) == 4 and all((r.turns is None) == (r.id in (2, 9)) for r in out)


def test_a_turn_above_twenty_million_characters(spark):
    size = 20_000_100
    rows = spark.range(1).selectExpr("7L as conv_id", "0L as turn", "'user' as role", "'q' as text").unionByName(spark.range(1).selectExpr("7L as conv_id", "1L as turn", "'assistant' as role", f"repeat('<\\\\', {size // 2}) as text"))
    r = chat.chat_digests(rows).first()
    text = "<\\" * (size // 2)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, size, hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\nq\nassistant\n{text}\n".encode()).hexdigest()


def test_roles_of_the_table_stay_and_null_turns_come_last(spark):
    turns = {1: [(0, "human", "a"), (1, "gpt", "b")], 2: [(0, "user", "q"), (1, "bot", "r"), (2, "model", "s")], 3: [(None, "assistant", "z"), (4, "system", "t")], 4: [(None, None, None), (0, "assistant", "x")]}
    rows = [(c, t, r, x, 1) for c, list_ in turns.items() for t, r, x in list_]
    out = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, back int")).collect()}
    for c, list_ in turns.items():
        list_ = sorted(((t, r or "", x or "") for t, r, x in list_), key=lambda t: (t[0] is None, t[0] or 0))
        loss = "".join(x for _, r, x in list_ if r == "assistant")
        assert out[c].n_turns == len(list_) and out[c].loss_chars == len(loss) and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in list_).encode()).hexdigest()
