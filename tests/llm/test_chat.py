"""Chat formatting against plain Python: control strings, backslashes, nulls, empty turns, ties, no replies, many turns, clashing columns."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from breakwater.llm import chat, queries

SF = "/root/testdata/sf0.001"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\b\\c", "<s><s></s>", "[[INST]INST]", "</s", "[/INST", "a\nb\r\n", "<\\/s>", "é\U0001f600 <s>", "\\</s>\\", ""]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def rows():
    out = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)]
    out += [(2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", None), (2, 3, "user", "last")]
    out += [(3, 0, "user", "no reply"), (4, 0, "assistant", "</s>"), (5, 0, "assistant", "a"), (5, 1, "assistant", "b"), (5, 2, "Assistant", "not a reply")]
    out += [(6, None, "user", "x"), (6, 1, "assistant", "y"), (6, 1, "assistant", "x"), (6, 1, "assistant", "x"), (6, -3, None, "z"), (None, 0, "user\nuser", "n"), (None, 1, "assistant", "m" * 200_000)]
    return out + [(7, i, ("user", "assistant", "tool")[i % 3], f"<s>{i}\\") for i in range(1100)]


def want(rows):
    """Digests and whole examples by conversation."""
    code = {"\\": "\\b", "<s>": "\\c", "</s>": "\\d", "[INST]": "\\e", "[/INST]": "\\f"}

    def esc(text, line=False):
        out, i = "", 0
        while i < len(text):
            hit = next((c for c in code if text.startswith(c, i)), None)
            out += code[hit] if hit else "\\n" if line and text[i] == "\n" else text[i]
            i += len(hit) if hit else 1
        return out

    found = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        sha = hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in turns).encode()).hexdigest()
        loss, whole, examples = "", "<s>", []
        for k, (_, _, role, text) in enumerate(turns):
            if role == "assistant":
                examples.append((whole + esc(text) + "</s>", len(whole), len(whole) + len(esc(text))))
                whole, loss = examples[-1][0], loss + text
            else:
                whole += f"[INST]{esc(role, True)}\n{esc(text)}[/INST]"
                if k == len(turns) - 1:
                    examples.append((whole, len(whole), len(whole)))
        found[conv] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(e[0]) for e in examples)), examples
    return found


def test_digests_and_whole_examples(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("bin", "piece", "example", "at", "part", "reply")}).repartition(3)
    expected = want(rows)
    got = {r[0]: tuple(r[1:]) for r in chat.digests(table).collect()}
    assert got == {c: d for c, (d, _) in expected.items()}
    whole = chat.expanded(chat.examples(table.where("conv_id IS NULL OR conv_id < 7"))).collect()
    for conv, (_, examples) in expected.items():
        if conv != 7:
            assert [(r.text, r.mask_start, r.mask_stop) for r in sorted(whole, key=lambda r: r.example) if r.conv_id == conv] == examples
    assert chat.digests(table.limit(0)).collect() == []


def test_digests_are_read_from_whole_examples(spark, rows, monkeypatch):
    made = {}

    def kept(df, label, **options):
        made[label] = chat_stored(df, label, **options)
        return made[label]

    chat_stored = chat.stored
    monkeypatch.setattr(chat, "stored", kept)
    monkeypatch.setattr(chat, "EXAMPLES", 7)
    expected = want(rows)
    chat.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    written = made["chat-examples"]
    found = {(r.conv_id, r.example): (r.text, r.mask_start, r.mask_stop) for r in written.collect()}
    assert found == {(c, i): e for c, (_, es) in expected.items() for i, e in enumerate(es)}
    changed = {r.conv_id: r for r in chat.read_back(written.withColumn("text", F.replace("text", F.lit("y"), F.lit("yy")))).collect()}  # in context and reply
    assert changed[6].turns_sha256 != expected[6][0][1] and changed[6].formatted_chars > expected[6][0][4]


def test_control_strings_stand_only_for_turns(spark, rows):
    parts = chat.examples(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert parts.part.str.count(r"\[INST\]").sum() == parts.part.str.count(r"\[/INST\]").sum() == sum(r[2] != "assistant" for r in rows)
    assert parts.part.str.count("</s>").sum() == sum(r[2] == "assistant" for r in rows) and not parts.part.str.contains("<s>").any()


def test_no_python_in_the_plan(spark):
    plan = chat.examples(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_sql_says_the_same(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    expected = {tuple(r) for r in db.execute(chat.ORACLE).df()[cols].itertuples(index=False)}
    assert {tuple(r) for r in queries.op11_reply_examples(spark, SF).select(cols).collect()} == expected
