"""Several values packed in one field: delimiter skeletons, rules per distinct skeleton, positional extraction.

A value is cut into tokens (words, digit runs, single signs); its skeleton holds one
character per token, with ordinary words masked, so that values that differ only in
their words share a skeleton. Where to cut is resolved once per distinct skeleton and
joined back; the pieces are then taken out of the token array by position, JVM-side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credograph.session import cut

#: Words that join two values, each with its skeleton character.
JOIN_WORDS = {"and": "A", "plus": "P", "with": "W", "followed": "F", "by": "B", "combined": "C", "in": "I", "combination": "M"}
#: Words that belong to a dose; a slash between two of them is no delimiter.
UNIT_WORDS = ["mg", "mcg", "ug", "µg", "g", "kg", "ml", "l", "m", "iu", "day", "d", "week", "wk", "h", "hr", "dose", "bid", "qd"]
#: ``n/a`` is a word.
TOKEN = r"[nN]/[aA](?!\p{L})|\p{L}+|\p{Nd}+|\r?\n|[^\S\r\n]+|."
#: Joining phrases as skeletons, longest first; ``~`` is any white space.
PHRASES = ["I~M~W", "C~W", "F~B", "A", "P", "W"]
CLOSING = {'"': '"', "“": "”", "'": "'", "‘": "’", "„": "“", "«": "»"}
SIGNS = ";；|•\n&+,/"
#: Up to so many distinct skeletons, and bytes of them and their rules in memory, are broadcast; beyond, the join is salted.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64_000_000


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(f"(?s)({TOKEN})"), F.lit(1))


def skeleton(toks: Column) -> Column:
    """One character per token."""

    def mask(t: Column) -> Column:
        low = F.lower(t)
        c = F.when(low.isin(UNIT_WORDS), F.lit("u"))
        for word, code in JOIN_WORDS.items():
            c = c.when(low == word, F.lit(code))
        return (
            c.when(t.rlike(r"^\p{L}"), F.lit("a"))
            .when(t.rlike(r"^\p{Nd}"), F.lit("9"))
            .when(t.contains("\n"), F.lit("\n"))
            .when(t.rlike(r"^\s"), F.lit(" "))
            .otherwise(F.substring(t, 1, 1))
        )

    return F.array_join(F.transform(toks, mask), "")


_STOP = r"(?=[ \n()" + "".join(SIGNS) + r"]|\z)"
_QUOTED = "(?s)^(?:" + "|".join(f"{q}.*?{m}" for q, m in CLOSING.items()) + ")" + _STOP
_PHRASE = "^(?:" + "|".join(p.replace("~", " ") for p in PHRASES) + r")(?=[ \n]|\z)"
_MARKERS = [r"^\(9\)", r"^9\)", r"^9\.(?= )"]  #: of a list's numbers


def _found(text: str, pattern: str) -> str:
    """SQL: how long the pattern's match in a text is, 0 without one."""
    return f"length(regexp_extract({text}, {_quoted(pattern)}, 0))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _text(begin: str, n: str) -> str:
    """SQL: the characters of a stretch; ``cs`` has one for each token."""
    return f"array_join(slice(cs, {begin} + 1, {n}), '')"


def _trimmed(b: str, e: str) -> str:
    """SQL: begin and end of what is left of a stretch without the white space around it; an empty one begins at -1."""
    return f"""aggregate(if({e} > {b}, sequence({b}, {e} - 1), cast(array() as array<int>)), named_struct('b', -1, 'e', -1),
        (a, i) -> if(cs[i] in (' ', '\\n'), a, named_struct('b', if(a.b < 0, i, a.b), 'e', i + 1)))"""


def cuts(skeletons: DataFrame) -> DataFrame:
    """``s, cuts`` of skeletons ``s``: begin and end (exclusive, in tokens) of each value, in SQL expressions only.

    Signs and joining words separate outside quotes and brackets; empty pieces are
    left out. Brackets and quotes that are never closed count as ordinary signs. One
    pass over the characters: at each, the first rule that holds says whether a value
    ends here, how many characters it takes, and whether nothing of the next has come yet.
    All rules but those of quotes and brackets look at the next few characters only, since
    white space is one token.
    """
    # few characters are taken one by one: a slice would copy the whole array at each step
    near = lambda offsets: "concat_ws('', " + ", ".join(f"get(cs, i + {k})" for k in offsets) + ")"
    c, before, ahead = "cs[i]", "if(i = 0, '', cs[i - 1])", near(range(8))
    apart = f"(i = 0 or {before} in (' ', '\n'))"
    marker = "case form " + " ".join(f"when {k} then {_found(ahead, m)}" for k, m in enumerate(_MARKERS, 1)) + " else 0 end"
    rest = _text("i", "size(cs) - i")
    opens, closes = "('(', '[', '{')", "(')', ']', '}')"
    depth = f"a.d + if(x in {opens}, 1, 0) - if(x in {closes}, 1, 0)"
    bracket = f"""if({c} not in {opens}, 0, aggregate(slice(cs, i + 1, size(cs) - i), named_struct('d', 0, 'k', 0, 'at', 0),
        (a, x) -> named_struct('d', {depth}, 'k', a.k + 1, 'at', if(a.at = 0 and {depth} = 0, a.k + 1, a.at))).at)"""
    marks = ", ".join(_quoted(q) for q in CLOSING)
    quote = f"if({c} not in ({marks}), 0, {_found(rest, _QUOTED)})"
    head = near((-3, -2, -1))
    number = f"""(({c} = ',' and {before} = '9' and {_found(ahead, "^,9(?!,9)")} > 0)
        or ({c} = '/' and (({_found(head, r"9 *\z")} > 0 and {_found(ahead, "^/ *9(?!,9)")} > 0) or ({_found(head, r"u *\z")} > 0 and {_found(ahead, "^/ *u")} > 0))))"""
    signs = ", ".join(_quoted(x) for x in SIGNS)
    move = f"""case
        when form > 0 and (i = first or t.m.fresh or {apart}) and {marker} > 0 then named_struct('cut', true, 'n', {marker}, 'fresh', true)
        when {c} = ' ' then named_struct('cut', false, 'n', 1, 'fresh', t.m.fresh)
        when t.m.fresh and {quote} > 0 then named_struct('cut', false, 'n', {quote}, 'fresh', false)
        when {bracket} > 0 then named_struct('cut', false, 'n', {bracket}, 'fresh', false)
        when {apart} and {_found(ahead, _PHRASE)} > 0 then named_struct('cut', true, 'n', {_found(ahead, _PHRASE)}, 'fresh', true)
        when {c} in ({signs}) and not {number} then named_struct('cut', true, 'n', 1, 'fresh', true)
        else named_struct('cut', false, 'n', 1, 'fresh', false) end"""
    # what is copied at each step is the last move, not the pieces: those grow by the one that the step before has ended
    start = "named_struct('skip', 0, 'begin', 0, 'fresh', true, 'b', -1, 'e', -1)"
    stay = "named_struct('skip', t.m.skip, 'begin', t.m.begin, 'fresh', t.m.fresh, 'b', -1, 'e', -1)"
    go = "named_struct('skip', i + m.n, 'begin', if(m.cut, i + m.n, t.m.begin), 'fresh', m.fresh, 'b', if(m.cut, t.m.begin, -1), 'e', if(m.cut, i, -1))"
    ended = "if(t.m.b < 0, t.out, array_append(t.out, named_struct('b', t.m.b, 'e', t.m.e)))"
    pieces = f"""aggregate(sequence(0, size(cs) - 1), named_struct('m', {start}, 'out', cast(array() as array<struct<b: int, e: int>>)),
        (t, i) -> named_struct('m', if(i < t.m.skip, {stay}, transform(array({move}), m -> {go})[0]), 'out', {ended}),
        t -> array_append({ended}, named_struct('b', t.m.begin, 'e', size(cs))))"""
    enclosed = f"p.e - p.b >= 2 and cs[p.b] in ({marks}) and {_found(_text('p.b', 'size(cs) - p.b'), _QUOTED)} = p.e - p.b"
    bare = f"transform(transform({pieces}, p -> {_trimmed('p.b', 'p.e')}), p -> if({enclosed}, {_trimmed('(p.b + 1)', '(p.e - 1)')}, p))"
    first = _found("s", r"^[ \n]+")
    form = "case " + " ".join(f"when {_found(_text(first, '8'), m)} > 0 then {k}" for k, m in enumerate(_MARKERS, 1)) + " else 0 end"
    found = f"transform(array(split(s, '')), cs -> transform(array(named_struct('first', {first}, 'form', {form})), z -> transform(filter({bare}, p -> p.e > p.b), p -> array(p.b, p.e)))[0])[0]"
    found = re.sub(r"\bform (?=>|when)", "z.form ", found).replace("i = first", "i = z.first")
    return skeletons.where("s <> ''").select("s", F.expr(found).alias("cuts"))


def split_packed(df: DataFrame, value: str, keep: list[str], pos: str = "pos", item: str = "item_value", broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns and, for each value packed in ``value``, its position from 1 and its text.

    Null, empty and blank fields and fields of nothing but delimiters give no row; repeated
    rows give repeated results; texts of any length are cut. Columns named like the
    output's are not carried along unless they are in ``keep``, where ``pos`` and
    ``item`` have to be given other names. A skeleton shared by a third of the rows does
    no harm: rules are broadcast while at most ``broadcast_rows`` of them exist, of at most
    ``broadcast_bytes`` (counted first), and joined salted beyond, never broadcast.
    """
    if clash := {pos, item} & set(keep):
        raise ValueError(f"{sorted(clash)} would be both kept and made")
    kept = [f"__k{n}" for n in range(len(keep))]
    base = df.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(value).alias("__v")).where(F.trim(F.regexp_replace("__v", r"\s+", " ")) != "")
    base = base.withColumn("__t", tokens(F.col("__v"))).withColumn("__s", skeleton(F.col("__t"))).drop("__v")
    rules = cut(cuts(base.select(F.col("__s").alias("s")).distinct()).select(F.col("s").alias("__s"), F.col("cuts").alias("__r")))
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(2 * F.octet_length("__s") + 32 * F.size("__r") + 100), F.lit(0))).first()
    if n <= broadcast_rows and size <= broadcast_bytes:
        joined = base.join(F.broadcast(rules), "__s")
    else:
        salts = 32
        # the planner knows the file's size only, which is far below that of the salted rows, and would broadcast them
        wide = rules.withColumn("__z", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        joined = base.withColumn("__z", F.pmod(F.xxhash64(*kept, "__s"), F.lit(salts)).cast("int")).join(wide, ["__s", "__z"])
    return joined.select(*kept, "__t", F.posexplode("__r").alias("__p", "__c")).select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept)],
        (F.col("__p") + 1).cast("int").alias(pos),
        F.expr("array_join(slice(__t, __c[0] + 1, __c[1] - __c[0]), '')").alias(item),
    )
