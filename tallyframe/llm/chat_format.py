"""Chat formatting by incremental black-box rendering (operator 8).

A template is any function from a list of ``{"role", "content"}`` to a string. It is rendered for each
successive prefix of a conversation's turns, and each output compared with the one before:

* ``append``: the output continues the one before; the turn's span is what was added;
* ``moved_tail``: the output before, but for a closing tail that has moved to the end, is continued; the
  span is what was put before the tail (if a turn begins like the tail, the common beginning counts
  to the tail before);
* ``rewrite``: the template changed what it had written for earlier turns. The span is what differs from
  the common beginning on, and no earlier span of that conversation is valid any more;
* ``error``: the template raised on this prefix; no span. Where the next prefix renders again, its turn's
  span holds what the failed turns added as well.

``valid`` says whether the span still holds in the rendering of the whole conversation.

Work: turns of a conversation come together by one shuffle and are read in order as a stream, one
conversation in memory at a time; rendering all prefixes is quadratic in the turns of a conversation,
which is the price of a template that can't be looked into.

Defined cases: a null role or text renders as an empty string; an empty text has a span as well (the
template's own marks). Turns are ordered by turn (null last), then role, then text; equal turns and
repeated rows are turns of their own. Rows with a null conversation id are one conversation each.
An empty table gives no rows. Offsets count characters. Ids and
turn numbers of any size are kept as they are (they travel as text). Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[dict[str, str]]], str]


def chatml(messages: list[dict[str, str]]) -> str:
    """Each turn between start and end marks."""
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)


def closed(messages: list[dict[str, str]]) -> str:
    """Turns in one pair of document marks: a tail that moves."""
    return "<doc>\n" + "".join(f"[{m['role']}] {m['content']}\n" for m in messages) + "</doc>"


def instruct(messages: list[dict[str, str]]) -> str:
    """System text is folded into the next user turn."""
    out, system = [], ""
    for m in messages:
        if m["role"] == "system":
            system = f"<<SYS>>\n{m['content']}\n<</SYS>>\n\n"
        elif m["role"] == "user":
            out.append(f"<s>[INST] {system}{m['content']} [/INST]")
            system = ""
        else:
            out.append(f" {m['content']} </s>")
    return "".join(out)


def last_thought_only(messages: list[dict[str, str]]) -> str:
    """Drops the ``<think>`` part of all but the last assistant turn: rewrites history."""
    last = max((k for k, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    hide = lambda k, m: re.sub(r"(?s)<think>.*?</think>", "", m["content"]) if m["role"] == "assistant" and k != last else m["content"]
    return "".join(f"<|{m['role']}|>{hide(k, m)}<|end|>" for k, m in enumerate(messages))


TEMPLATES: dict[str, Template] = {"chatml": chatml, "closed": closed, "instruct": instruct, "last_thought_only": last_thought_only}


def locate(messages: list[dict[str, str]], template: Template) -> tuple[list[tuple[int | None, int | None, str, bool]], str]:
    """(start, end, status, valid) of each turn, and the whole rendering."""
    spans: list[tuple[int | None, int | None, str, bool]] = []
    before = ""
    for k in range(len(messages)):
        try:
            now = template([dict(m) for m in messages[: k + 1]])
        except Exception:  # noqa: BLE001 - the template is a black box
            spans.append((None, None, "error", False))
            continue
        if now.startswith(before):
            spans.append((len(before), len(now), "append", True))
        else:
            common = len(os.path.commonprefix([before, now]))
            tail = before[common:]
            if len(now) - len(tail) >= common and now.endswith(tail):
                # the turn before ended where its tail began
                spans = [(s, min(e, common), how, ok) if e is not None else (s, e, how, ok) for s, e, how, ok in spans]
                spans.append((common, len(now) - len(tail), "moved_tail", True))
            else:
                spans = [(s, e, how, ok and e is not None and e <= common) for s, e, how, ok in spans]
                spans.append((common, len(now), "rewrite", True))
        before = now
    return spans, before


def chat_spans(turns: DataFrame, template: Template = chatml, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, span_start, span_end, status, valid, rendered), one for each turn.

    ``rendered`` is the span in the whole conversation's rendering (null if it isn't valid).
    """
    kind = turns.schema[id_col].dataType.simpleString()
    src = turns.select(F.col(id_col).cast("string").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    names = ["conv_id", "turn", "role", "span_start", "span_end", "status", "valid", "rendered"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=names)
        for c in ("span_start", "span_end"):
            f[c] = f[c].astype("Int64")
        return f

    def finish(conv, turn: list, role: list, text: list) -> list[tuple]:
        messages = [{"role": r if r is not None else "", "content": x if x is not None else ""} for r, x in zip(role, text)]
        spans, whole = locate(messages, template)
        return [(conv, t, r, s, e, how, ok, whole[s:e] if ok else None) for t, r, (s, e, how, ok) in zip(turn, role, spans)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, turn, role, text = None, [], [], []
        for b in batches:
            out: list[tuple] = []
            for c, t, r, x in zip(b["conv_id"], b["turn"], b["role"], b["text"]):
                if turn and (c is None or c != now):
                    out += finish(now, turn, role, text)
                    turn, role, text = [], [], []
                now = c
                turn.append(t)
                role.append(r)
                text.append(x)
            yield frame(out)
        if turn:
            yield frame(finish(now, turn, role, text))

    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.xxhash64("conv_id"))
    sorted_ = src.repartition(spread).sortWithinPartitions(*order).withColumn("turn", F.col("turn").cast("string"))
    spans = sorted_.mapInPandas(run, "conv_id string, turn string, role string, span_start long, span_end long, status string, valid boolean, rendered string")
    return spans.withColumns({"conv_id": F.col("conv_id").cast(kind), "turn": F.col("turn").cast("long")})


ORACLE = """
WITH r AS (SELECT conv_id, turn, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM conversations),
s AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM r)
SELECT conv_id, turn, role, CAST(e - length(rendered) AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end,
       'append' AS status, TRUE AS valid, rendered FROM s
"""
