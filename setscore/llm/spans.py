"""Spans of regular-expression matches in column expressions (code points, end exclusive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def gather(items: Column, kind: str, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]],
           finish: Callable[[Column, Column], Column] | None = None) -> Column:
    """Walk over ``items`` and gather values: ``step(acc, item)`` gives the new state, whether there is
    a value, and the value, of type ``kind``. ``finish(acc, values)`` makes the result.

    An accumulator is copied at every step, so one that gathers n values one by one copies n * n of
    them. Here n items go in about sqrt(n) runs of sqrt(n), each gathered by itself.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    pack = lambda get, values: F.struct(*[get[k].alias(k) for k in state], values.alias("values"))

    def go(acc: Column, item: Column) -> Column:
        new, some, value = step(acc, item)
        return pack(new, F.when(some, F.concat(acc["values"], F.array(value))).otherwise(acc["values"]))

    def walk(every: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(every) + 1)).cast("int")
        starts = F.sequence(F.lit(1), F.size(every) + 1, run)
        return F.aggregate(starts, pack(state, nones), lambda acc, at: _bound(
            F.aggregate(F.slice(every, at, run), pack({k: acc[k] for k in state}, none), go),
            lambda one: pack(one, F.concat(acc["values"], F.array(one["values"])))))

    return _bound(_bound(items, walk), lambda acc: F.flatten(acc["values"]) if finish is None else finish(acc, F.flatten(acc["values"])))


SPAN = SPAN_TYPE[len("array<"):-1]


def match_spans(text: Column, pattern: str, kind_no: int, kind: str, passes: Callable[[Column], Column],
                gate: Column, original: Column | None = None) -> Column:
    """SPAN_TYPE array of the leftmost non-overlapping matches of ``pattern`` that pass.
    ``original``: if ``text`` is a marked copy of it, what the values are cut from.

    The places follow from the lengths of the pieces between matches, so one walk over both lists
    gives them. Texts that fail ``gate`` (a cheap necessary condition) are not searched.
    """
    def step(acc: Column, pair: Column):
        begin = acc["at"] + F.length(pair["piece"])
        size = F.coalesce(F.length(pair["match"]), F.lit(0))       # the last piece has no match after it
        value = pair["match"] if original is None else original.substr(begin + 1, size)
        span = F.struct(begin.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (begin + size).alias("end"), value.alias("value"))
        return {"at": begin + size}, pair["match"].isNotNull() & passes(pair["match"]), span

    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.when(gate, gather(pairs, SPAN, {"at": F.lit(0)}, step)).otherwise(no_spans())


MARK = "\uE000"


def marked(text: Column, pattern: str) -> Column:
    """A copy of ``text`` of the same length in which each one-character match of ``pattern`` is MARK.

    With it a repeated group becomes a repeated character class, which the regular expression engine
    walks without recursion, however long the match. A MARK that the text has itself becomes another private character.
    """
    return F.regexp_replace(F.translate(text, MARK, "\uE001"), pattern, MARK)


def by_start(spans: Column) -> Column:
    """Sorted by start, then by kind as listed."""
    return F.array_sort(spans)


def by_kind(spans: Column) -> Column:
    """Sorted by kind as listed, then by start."""
    return F.array_sort(spans, lambda a, b: F.when(a["kind_no"] != b["kind_no"], a["kind_no"] - b["kind_no"])
                        .otherwise(a["start"] - b["start"]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def beside(spans: Column, others: Column) -> Column:
    """The ``spans``, none of which overlap each other, that overlap none of ``others``; by start.

    One walk over both: a span waits until the next one, or the end, shows that nothing begins inside it.
    """
    mine = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s.alias("span")))
    rest = F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s.alias("span")))
    nothing = F.lit(None).cast(SPAN)

    def step(acc: Column, x: Column):
        own, s, waiting = x["own"] == 1, x["span"], acc["waiting"]
        clear = own & (s["start"] >= acc["upto"])
        hit = ~own & waiting.isNotNull() & (s["start"] < waiting["end"])
        new = {"upto": F.when(own, acc["upto"]).otherwise(F.greatest(acc["upto"], s["end"])),
               "waiting": F.when(clear, s).when(own | hit, nothing).otherwise(waiting)}
        return new, own & waiting.isNotNull(), waiting

    finish = lambda acc, values: F.when(acc["waiting"].isNull(), values).otherwise(F.concat(values, F.array(acc["waiting"])))
    walked = gather(F.array_sort(F.concat(mine, rest)), SPAN, {"upto": F.lit(0), "waiting": nothing}, step, finish)
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), by_start(spans)).otherwise(walked)


def replaced(text: Column, spans: Column, word: Callable[[Column], Column]) -> Column:
    """``text`` with every span exchanged for ``word(span)``; a span that begins inside the one
    before is skipped."""
    def step(acc: Column, s: Column):
        some = s["start"] >= acc["at"]
        return ({"at": F.when(some, s["end"]).otherwise(acc["at"])}, some,
                F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), word(s)))

    finish = lambda acc, pieces: F.concat(F.array_join(pieces, ""), text.substr(acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(gather(by_start(spans), "string", {"at": F.lit(0)}, step, finish))
