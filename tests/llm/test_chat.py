"""Chat formatting: reversible marks, one example per reply, odd rows."""

import hashlib

from postlark.llm import chat as C

ODD = "\\### assistant: </turn>\n\\h\\b<#:\\"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", ODD), (1, 2, "assistant", ODD), (1, 3, "user", None),
    (1, 4, "assistant", ""), (1, 5, "assistant", "last 日本"), (1, 6, "user", "trailing"),
    (2, 0, "user", "no reply"), (None, 1, "assistant", "b"), (None, None, "assistant", "a"),
    (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 1, None, "x"), (3, 0, ODD, "y"),
    (4, 0, "assistant", "z" * 100_000),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, reply string")


def turns():
    out = {}
    order = lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(ROWS, key=order):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_examples_hold_all_that_came_before_and_only_the_reply_is_trained(spark):
    formatted = C.format_conversations(frame(spark))
    got = {}
    for row in C.expand(formatted).collect():
        got.setdefault(row.conv_id, {})[row.example] = row
    whole = {row.conv_id: row.formatted for row in formatted.collect()}
    escape = lambda text, pairs: [text := text.replace(*pair) for pair in pairs][-1]
    for conv, said in turns().items():
        text, number = "", 0
        for role, said_text in said:
            head = f"### {escape(role, C._ROLE_ESCAPES)}: "
            body = escape(said_text, C._ESCAPES)
            if role == "assistant":
                row = got[conv][number]
                assert (row.context, row.target) == (text + head, body)
                assert (row.loss_start, row.loss_chars) == (len(text + head), len(body))
                number += 1
            text += head + body + "</turn>\n"
        assert whole[conv] == text and len(got.get(conv, {})) == number


def test_everything_is_read_back(spark):
    formatted = C.format_conversations(frame(spark))
    read = {r.conv_id: r for r in formatted.select("conv_id", C.read_turns(formatted.formatted).alias("turns")).collect()}
    digests = {r.conv_id: r for r in C.digests(formatted).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert set(read) == set(digests) == set(turns())
    for conv, said in turns().items():
        assert [tuple(t) for t in read[conv].turns] == said
        loss = "".join(text for role, text in said if role == "assistant")
        row = digests[conv]
        assert row.n_turns == len(said) and row.loss_chars == len(loss) and row.loss_sha256 == sha(loss)
        assert row.turns_sha256 == sha("".join(f"{role}\n{text}\n" for role, text in said))


def test_no_rows(spark):
    formatted = C.format_conversations(frame(spark).where("false"))
    assert formatted.collect() == C.expand(formatted).collect() == C.digests(formatted).collect() == []
