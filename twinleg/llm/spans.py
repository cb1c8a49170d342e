"""Spans of regular expressions in texts as column expressions: code points, end exclusive, leftmost and non-overlapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,hit:string>>"


def quoted(pattern: str) -> str:
    """A SQL string literal of a pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, kind: str, where: str = "true") -> Column:
    """Spans of ``pattern`` in the column ``text``: hits, and their places from the lengths of what lies between.

    ``where`` is a cheap test that a text with a hit always passes.  The hits are looked for first, so texts without one are
    scanned once.  Places are running sums, taken in blocks of about the square root of the number of hits, so the work for k
    hits grows as k to the power 1.5 and no array is built up piece by piece.
    """
    q = quoted(pattern)
    add = "0, (s, v) -> s + v"
    end = f"aggregate(slice(sums, 1, int(i div b)), {add}) + aggregate(slice(steps, int(i div b) * b + 1, i % b + 1), {add})"
    return F.expr(f"""
        transform(array(if({where}, regexp_extract_all({text}, {q}, 0), array())), h -> if(size(h) = 0, cast(array() as {SPAN}),
            transform(array(transform(arrays_zip(h, slice(split({text}, {q}, -1), 1, size(h))), x -> length(x['1']) + length(x['h']))), steps ->
                transform(array(greatest(1, int(sqrt(size(steps))))), b ->
                    transform(array(transform(sequence(0, int((size(steps) - 1) div b)), k -> aggregate(slice(steps, k * b + 1, b), {add}))), sums ->
                        transform(transform(h, (v, i) -> named_struct('v', v, 'at', {end})),
                            y -> named_struct('kind', '{kind}', 'start', y.at - length(y.v), 'end', y.at, 'hit', y.v))
                    )[0])[0])[0]))[0]""")


def span_text(spans: str, kinds: list[str], by_kind: bool) -> Column:
    """kind:start:end joined by commas, sorted by kind (in the order given) then start, or by start then kind."""
    order = ", ".join(f"'{k}'" for k in kinds)
    rank = f"array_position(array({order}), x.kind)"
    keys = f"'a', {rank}, 'b', x.start" if by_kind else f"'a', cast(x.start as bigint), 'b', cast({rank} as int)"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct({keys}, 's', concat(x.kind, ':', x.start, ':', x.end)))), x -> x.s), ',')")


def clear_of(spans: str, others: str) -> Column:
    """Those of ``spans`` that overlap none of ``others``."""
    return F.expr(f"filter({spans}, x -> not exists({others}, o -> o.start < x.end and x.start < o.end))")


def replaced(text: str, spans: str, mark: str) -> Column:
    """``text`` with each span replaced by ``mark``; overlapping spans count as one.  ``mark`` may use x.kind."""
    return F.expr(f"""
        case when size({spans}) = 0 then {text} else aggregate(array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'mark', {mark}))),
            named_struct('at', 0, 'out', cast(array() as array<string>)),
            (a, x) -> if(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out),
                named_struct('at', x.end, 'out', concat(a.out, array(substring({text}, a.at + 1, x.start - a.at), x.mark)))),
            a -> concat(array_join(a.out, ''), substring({text}, a.at + 1))) end""")
