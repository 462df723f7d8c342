"""Column functions over text: white space, positions of matches, context windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and word edges over ASCII letters, digits and _.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = WS.replace("[", "[^", 1)
EDGE_LEFT, EDGE_RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
MARK = "\u0001"


WS_SIGNS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_SIGNS))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, lower case."""
    return F.lower(F.regexp_replace(c, f"{WS}+", " "))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def sign_count(c: Column, sign: str) -> Column:
    """How often a text has one character."""
    return (F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))).cast("long")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Array items that a fold walks over at once. What a fold gathers is copied at each step, so a long array is cut
#: into blocks of this size, whose results are joined once.
BLOCK = 256


def hits(text: Column, pattern: str) -> Column:
    """array<struct<pos, m>> of a pattern's matches, positions from 0. Matches are marked in place, so
    look-around sees the text itself; texts without a match skip the fold."""
    none = F.expr("cast(array() as array<struct<pos:int,m:string>>)")

    def fold(parts: Column, at) -> Column:
        """parts alternate between what lies outside and inside of matches."""
        return F.aggregate(
            parts,
            F.struct(at.alias("at"), F.lit(False).alias("odd"), none.alias("found")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x)).alias("at"), (~a["odd"]).alias("odd"),
                F.when(a["odd"], F.concat(a["found"], F.array(F.struct(a["at"].alias("pos"), x.alias("m"))))).otherwise(a["found"]).alias("found"),
            ),
            lambda a: a["found"],
        )

    def blocks(parts: Column) -> Column:
        own = lambda i: F.slice(parts, i * BLOCK + 1, F.lit(BLOCK))
        each = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
        sizes = F.transform(each, lambda i: F.aggregate(own(i), F.lit(0), lambda n, x: n + F.length(x)))
        starts = F.aggregate(
            sizes, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"],
        )
        return let(starts, lambda at: F.flatten(F.transform(each, lambda i: fold(own(i), F.get(at, i)))))

    marked = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("")), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = let(marked, lambda parts: F.when(F.size(parts) <= BLOCK, fold(parts, F.lit(0))).otherwise(blocks(parts)))
    return F.when(text.rlike(pattern), found).otherwise(none)


#: Characters of a piece of a text; what piece() gives is at most so long.
PIECE = 256


def cut(text: Column) -> Column:
    """struct<pieces, size>: a text made ready for piece() and window(), which look at two of its pieces each
    instead of walking over the text from its start."""
    whole = F.when(F.octet_length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return F.struct(whole.alias("pieces"), F.length(text).alias("size"))


def piece(ready: Column, start: Column, size) -> Column:
    """At most PIECE characters of a cut() text from a position on."""
    k = F.floor(start / PIECE).cast("int")
    near = F.concat(F.coalesce(F.get(ready["pieces"], k), F.lit("")), F.coalesce(F.get(ready["pieces"], k + 1), F.lit("")))
    return F.substring(near, start - k * PIECE + 1, size if isinstance(size, Column) else F.lit(size))


def window(ready: Column, pos: Column, radius: int) -> Column:
    """What stands around a position of a cut() text, with ... where it is cut off."""
    start = F.greatest(F.lit(0), pos - radius)
    end = F.least(ready["size"], pos + radius)
    return F.concat(F.when(start > 0, "...").otherwise(""), piece(ready, start, end - start), F.when(end < ready["size"], "...").otherwise(""))


def spliced(ready: Column, pos: Column, radius: int, size: Column, new: Column) -> Column:
    """The window with the match at pos replaced."""
    start = F.greatest(F.lit(0), pos - radius)
    local = pos - start + F.when(start > 0, 3).otherwise(0)
    around = window(ready, pos, radius)
    return F.concat(F.substring(around, F.lit(1), local), new, F.substring(around, local + size + 1, F.length(around)))


def at_hits(text: Column, pattern: str, made, keep=None) -> Column:
    """made(ready, hit) for each match of a pattern that keep(ready, hit) lets through, ready being cut(text);
    null where there is no match."""
    found = hits(text, pattern)

    def each(ready: Column) -> Column:
        kept = found if keep is None else F.filter(found, lambda x: keep(ready, x))
        return F.transform(kept, lambda x: made(ready, x))

    return F.when(text.rlike(pattern), let(cut(text), each))


class Stack:
    """A stack of whole numbers within stacks_after(): what earlier blocks of items left of it (never copied here), and
    the changes of this block."""

    def __init__(self, before: Column, now: Column):
        self.before, self.last, self.taken = before, now["last"], now["taken"]

    def top(self) -> Column:
        """The number pushed last, null where the stack is empty."""
        n = F.size(self.last)
        return F.when(n > 0, F.get(self.last, n - 1)).otherwise(F.get(self.before, F.size(self.before) - 1 - self.taken))

    def pushed(self, x: Column) -> Column:
        return F.struct(F.concat(self.last, F.array(x)).alias("last"), self.taken.alias("taken"))

    def popped(self) -> Column:
        """Without its top, which there must be."""
        n = F.size(self.last)
        fewer = F.slice(self.last, F.lit(1), F.greatest(n - 1, F.lit(0)))
        return F.struct(fewer.alias("last"), F.when(n > 0, self.taken).otherwise(self.taken + 1).alias("taken"))

    def replaced(self, x: Column) -> Column:
        """With another top."""
        n = F.size(self.last)
        fewer = F.slice(self.last, F.lit(1), F.greatest(n - 1, F.lit(0)))
        return F.struct(F.concat(fewer, F.array(x)).alias("last"), F.when(n > 0, self.taken).otherwise(self.taken + 1).alias("taken"))


def stacks_after(items: Column, names: list[str], step) -> Column:
    """struct with an array<int> for each name: stacks after a walk over items. step(stacks by name, item) says which
    stacks change, as a list of (condition, {name: changed stack}), the first that holds counting. A fold copies what it
    carries at each step; so blocks of items are folded with their own changes only, which then join the stacks."""
    none, untouched = F.expr("cast(array() as array<int>)"), F.expr("cast(named_struct('last', array(), 'taken', 0) as struct<last:array<int>,taken:int>)")

    def one(before: Column, now: Column, x: Column) -> Column:
        changed = lambda new: F.struct(*[new.get(k, now[k]).alias(k) for k in names])
        (first, new), *rest = step({k: Stack(before[k], now[k]) for k in names}, x)
        out = F.when(first, changed(new))
        for condition, new in rest:
            out = out.when(condition, changed(new))
        return out.otherwise(now)

    def joined(before: Column, now: Column) -> Column:
        return F.struct(*[F.concat(F.slice(before[k], F.lit(1), F.size(before[k]) - now[k]["taken"]), now[k]["last"]).alias(k) for k in names])

    def walk(every: Column) -> Column:
        def block(before: Column, i: Column) -> Column:
            own = F.slice(every, i * BLOCK + 1, F.lit(BLOCK))
            return let(F.aggregate(own, F.struct(*[untouched.alias(k) for k in names]), lambda now, x: one(before, now, x)), lambda now: joined(before, now))

        each = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")))
        return F.aggregate(each, F.struct(*[none.alias(k) for k in names]), block)

    return let(items, walk)


def unit_hash(text: Column, start: Column | None = None) -> Column:
    """32-bit FNV-1a over UTF-16 units, as a long; with start, what goes on from a hash. One pass over the
    characters: one beyond the first plane is two units."""
    code = lambda c: F.ascii(c).cast("long")
    step = lambda h, u: ((h.bitwiseXOR(u)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    high = lambda x: F.shiftright(x - 65536, 10) + 0xD800
    low = lambda x: (x - 65536).bitwiseAND(F.lit(1023)) + 0xDC00
    fold = lambda h, x: F.when(x < 65536, step(h, x)).otherwise(step(step(h, high(x)), low(x)))
    first = F.lit(2166136261).cast("long") if start is None else start
    codes = F.transform(F.split(text, "", -1), code)
    return F.when(text == "", first).otherwise(F.aggregate(codes, first, fold))
