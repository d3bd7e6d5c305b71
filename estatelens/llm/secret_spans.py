"""Secret scans in DataFrame functions: fixed patterns and sliding-window Shannon entropy.

Candidates of the entropy scan are runs of token characters with a digit in them. A window of WINDOW characters moves
along each; its character counts and their entropy term are updated by the character that enters and the one that
leaves. A window is suspicious if it has digits and letters, is hexadecimal in one case, of upper case and digits only, of
lower case and digits only, or has both cases, and its entropy reaches the threshold of that class. Of a candidate the
stretches of letters, digits and + that hold a match of the allow-list are left out, and so are spans inside a span of
a fixed pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 20
# Least entropy in bits of a window of each class.
HEX_BITS, MIXED_BITS = 3.0, 3.75
# Of the classes of upper case and digits, and lower case and digits, which words with numbers fall into, too.
UPPER_BITS, LOWER_BITS = 3.5, 3.75
SCALE = 1 << 16
# count -> count * log2(count), in units of 1 / SCALE bits: whole numbers, so that adding and taking away is exact.
# One more than a window holds, as a character enters before one leaves.
TERMS = [0] + [round(SCALE * n * math.log2(n)) for n in range(1, WINDOW + 2)]


def _most(bits: float) -> int:
    """Largest sum of terms of a window whose entropy is `bits` or more."""
    return int(SCALE * WINDOW * (math.log2(WINDOW) - bits))


HEX_MOST, MIXED_MOST, UPPER_MOST, LOWER_MOST = map(_most, (HEX_BITS, MIXED_BITS, UPPER_BITS, LOWER_BITS))

ASSIGN = ("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
          r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# kind -> (pattern, group whose length counts, least length), in the order of equal starts.
PLAIN = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
# The same for the scan: a run that is too short holds no longer match, so the least length can be in the pattern.
BASE = PLAIN | {"access": ("AKIA[A-Z0-9]{16,}", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
# Well-known harmless shapes: UUIDs, placeholders, counting sequences, long runs of one character.
ALLOW = ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[eE][xX][aA][mM][pP][lL][eE]|"
         "[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]|[xX]{6}|0{8}|12345678|abcdefgh|ABCDEFGH")
# What a match of the allow-list takes with it, at either end.
JOINED = "^[A-Za-z0-9+]*"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(rows: DataFrame, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """`rows` with an array `name` of (start, end, match): leftmost matches in `text`, those with a long enough group."""
    lit = text_literal(pattern)
    own = "m" if group == 0 else f"if(size(m) = 0, m, regexp_extract_all(text, {lit}, {group}))"
    # The texts between matches and the matches themselves give all positions.
    rows = rows.withColumn("m", F.expr(f"regexp_extract_all(text, {lit}, 0)"))
    rows = rows.withColumn("g", F.expr(own)).withColumn("gaps", F.expr(f"if(size(m) = 0, m, slice(split(text, {lit}, -1), 1, size(m)))"))
    rows = rows.withColumn("starts", F.expr("""aggregate(
        zip_with(gaps, m, (gap, x) -> struct(char_length(gap) as gap, char_length(x) as n)),
        struct(0 as at, cast(array() as array<int>) as starts),
        (s, x) -> struct(s.at + x.gap + x.n as at, concat(s.starts, array(s.at + x.gap)) as starts), s -> s.starts)"""))
    return rows.withColumn(name, F.expr(f"""filter(transform(starts, (at, i) -> struct(
        at as start, at + char_length(m[i]) as end, m[i] as m, char_length(g[i]) >= {least} as long)), x -> x.long)""")).drop(
        "m", "g", "gaps", "starts")


def windows(run: str) -> str:
    """SQL for an array of (start, end) of the merged suspicious windows of the characters `run`.

    State: counts as one letter a character of ALPHABET (A for none), the sum of terms, characters of each class in
    the window, and the spans so far.
    """
    terms = "array(" + ", ".join(map(str, TERMS)) + ")"
    alphabet = text_literal(ALPHABET)

    def count(state: str, at: str) -> str:
        return f"(ascii(substring({state}.counts, {at}, 1)) - 65)"

    def moved(state: str, at: str, by: int) -> str:
        """The state after the character number `at` of ALPHABET entered (1) or left (-1)."""
        term = f"element_at({terms}, {count(state, at)} + {1 + by}) - element_at({terms}, {count(state, at)} + 1)"
        return f"""struct(overlay({state}.counts placing chr({count(state, at)} + {65 + by}) from {at} for 1) as counts,
          {state}.sum + {term} as sum,
          {state}.hex + if({at} <= 16, {by}, 0) as hex,
          {state}.capital + if({at} <= 10 or {at} between 37 and 42, {by}, 0) as capital, {state}.digit + if({at} <= 10, {by}, 0) as digit,
          {state}.lower + if({at} between 11 and 36, {by}, 0) as lower, {state}.upper + if({at} between 37 and 62, {by}, 0) as upper,
          {state}.spans as spans)"""

    entered = moved("s", f"locate({run}[i], {alphabet})", 1)
    left = f"transform(array({entered}), s -> if(i < {WINDOW}, s, {moved('s', f'locate({run}[i - {WINDOW}], {alphabet})', -1)}))[0]"
    suspicious = f"""i >= {WINDOW - 1} and s.digit > 0 and s.lower + s.upper > 0 and
        (((s.hex = {WINDOW} or s.capital = {WINDOW}) and s.sum <= {HEX_MOST}) or (s.lower > 0 and s.upper > 0 and s.sum <= {MIXED_MOST})
          or (s.digit + s.upper = {WINDOW} and s.sum <= {UPPER_MOST}) or (s.digit + s.lower = {WINDOW} and s.sum <= {LOWER_MOST}))"""
    spans = f"""if({suspicious},
        if(size(s.spans) > 0 and element_at(s.spans, -1).end >= i - {WINDOW - 1},
          concat(slice(s.spans, 1, size(s.spans) - 1), array(named_struct('start', element_at(s.spans, -1).start, 'end', i + 1))),
          concat(s.spans, array(named_struct('start', i - {WINDOW - 1}, 'end', i + 1)))), s.spans)"""
    return f"""aggregate(sequence(0, size({run}) - 1),
      struct('{'A' * len(ALPHABET)}' as counts, 0 as sum, 0 as hex, 0 as capital, 0 as digit, 0 as lower, 0 as upper,
        cast(array() as array<struct<start: int, end: int>>) as spans),
      (before, i) -> transform(transform(array(before), s -> {left}), s -> struct(s.counts as counts, s.sum as sum, s.hex as hex,
        s.capital as capital, s.digit as digit, s.lower as lower, s.upper as upper, {spans} as spans))[0],
      s -> s.spans)"""


def stretches(run: str) -> str:
    """SQL for an array of (start, m): what the allow-list leaves of the candidate `run`, a struct of start and m."""
    allow, joined = text_literal(ALLOW), text_literal(JOINED)
    parts = f"""zip_with(split({run}.m, {allow}, -1), regexp_extract_all({run}.m, {allow}, 0), (gap, x) -> struct(gap, char_length(x) as n))"""
    return f"""if(not {run}.m rlike {allow}, array(struct({run}.start as start, {run}.m as m)), aggregate({parts},
        struct({run}.start as at, 0 as lead, cast(array() as array<struct<start: int, m: string>>) as out),
        (s, x) -> struct(s.at + char_length(x.gap) + coalesce(x.n, 0) as at, 1 as lead,
          transform(array(if(s.lead = 1, char_length(regexp_extract(x.gap, {joined}, 0)), 0)), lead -> concat(s.out, array(named_struct(
            'start', s.at + lead, 'm', substring(x.gap, lead + 1, greatest(0, char_length(x.gap) - lead -
              if(x.n is null, 0, char_length(regexp_extract(reverse(x.gap), {joined}, 0)))))))))[0] as out),
        s -> s.out))"""


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed patterns, base_sha256 and all spans of every whole text.

    Spans are "kind:start:end", in code points with the end exclusive, ordered by start, then kind. A null or empty
    text has none. Rows are scanned one by one: repeated rows, null ids and other columns do no harm, and nothing is
    shuffled. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = list(BASE)
    for kind, (pattern, group, least) in BASE.items():
        rows = found(rows, kind, pattern, group, least)
    rows = found(rows, "runs", CANDIDATE, 0, WINDOW).withColumn("runs", F.expr(
        f"""transform(filter(flatten(transform(runs, r -> {stretches('r')})), x -> x.m rlike '[0-9]' and char_length(x.m) >= {WINDOW}),
          x -> struct(x.start as start, slice(split(x.m, '', -1), 1, char_length(x.m)) as chars))"""))
    rows = rows.withColumn("base", F.expr("concat(" + ", ".join(
        f"transform({kind}, x -> struct(x.start as start, {place} as place, x.end as end))" for place, kind in enumerate(kinds)) + ")"))
    rows = rows.withColumn("entropy", F.expr(f"""filter(flatten(transform(runs, r ->
        transform({windows('r.chars')}, w -> struct(r.start + w.start as start, {len(kinds)} as place, r.start + w.end as end)))),
        w -> not exists(base, b -> b.start <= w.start and b.end >= w.end))"""))
    names = "array(" + ", ".join(f"'{k}'" for k in [*kinds, "entropy"]) + ")"

    def joined(spans: str) -> Column:
        return F.expr(f"array_join(transform(array_sort({spans}), x -> concat_ws(':', {names}[x.place], x.start, x.end)), ',')")

    return rows.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("concat(base, entropy)").alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))


def _duck(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _found_sql(name: str, pattern: str, group: int, least: int) -> str:
    lit = _duck(pattern)
    return f"""{name}_raw AS (SELECT doc_id, regexp_extract_all(text, {lit}, 0) AS m, regexp_extract_all(text, {lit}, {group}) AS g,
      string_split_regex(text, {lit}) AS gaps FROM docs WHERE regexp_matches(text, {lit})),
    {name}_all AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g, gaps FROM {name}_raw),
    {name}_f AS (SELECT doc_id, m[i] AS m, CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS start,
      length(m[i]) AS n FROM {name}_all WHERE length(g[i]) >= {least})"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 {','.join(_found_sql(k, *v) for k, v in PLAIN.items())},
 {_found_sql('run', CANDIDATE, 0, WINDOW)},
 base AS ({' UNION ALL '.join(f"SELECT doc_id, {p} AS place, '{k}' AS kind, start, start + n AS stop FROM {k}_f" for p, k in enumerate(BASE))}),
 runs AS (SELECT DISTINCT doc_id, start, m FROM run_f WHERE regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, {_duck(ALLOW)})),
 places AS (SELECT doc_id, start, m, unnest(range(length(m) - {WINDOW - 1})) AS w FROM runs),
 win AS (SELECT doc_id, start, w, substr(m, w + 1, {WINDOW}) AS s FROM places),
 letters AS (SELECT doc_id, start, w, s, unnest(string_split(s, '')) AS c FROM win),
 counted AS (SELECT doc_id, start, w, s, c, count(*) AS n FROM letters GROUP BY ALL),
 summed AS (SELECT doc_id, start, w, s, sum({TERMS}[n + 1]) AS total FROM counted GROUP BY ALL),
 odd AS (SELECT doc_id, start, w FROM summed WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-z]') AND
   ((regexp_full_match(s, '[0-9a-f]+') AND total <= {HEX_MOST}) OR (regexp_matches(s, '[A-Z]') AND total <= {MIXED_MOST}))),
 breaks AS (SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY doc_id, start ORDER BY w) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM odd),
 islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY w) AS island FROM breaks),
 merged AS (SELECT doc_id, start + min(w) AS start, start + max(w) + {WINDOW} AS stop FROM islands GROUP BY doc_id, islands.start, island),
 entropy AS (SELECT DISTINCT * FROM merged e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND b.stop >= e.stop)),
 spans AS (SELECT * FROM base UNION ALL SELECT doc_id, {len(BASE)}, 'entropy', start, stop FROM entropy),
 per AS (SELECT doc_id, {','.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in [*BASE, 'entropy'])},
   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (WHERE kind <> 'entropy') AS b,
   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS a FROM spans GROUP BY doc_id)
SELECT d.doc_id, {','.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in [*BASE, 'entropy'])},
 sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM docs d LEFT JOIN per USING (doc_id)
"""
