"""Values that were cut off, and each source's share of them, in SQL.

Method: word trigrams are counted inside all texts and titles and at their ends; the final trigram of each value is
joined to both counts. A final trigram that is frequent inside but almost never terminal, or whose last word is only the
beginning of the words that follow the two before it, tells a cut. Counts become rates that back off from the trigram to
its last two words and its last word (sentence ends and brackets are words of their own; in raw_html, tags are the words),
so a verdict depends on rates and not on the size of the table. The odds of a cut are

    odds(length) x odds(final trigram is inside : it is an end) x odds(mark)

Length is the second opinion: a source's values crowd at a limit (in characters or bytes) by more than their neighbours;
the excess over these is the prior of a cut, leaning on the crowd of all sources where a source has few values. Marks (dots,
a bracketed note, a blank at the end, in raw_html more open tags than the source's pages usually leave) weigh as much as
they distinguish cut from complete values in the same source, at a limit and apart from it. Cut values must not count as
ends, and marks need verdicts: ``ROUNDS`` rounds of expectation-maximization weigh every end by its odds. Only half a
character at the end (U+FFFD) tells a cut without odds.

Defined results: null and blank values are no cases; a final word of more than ``WORD_LETTERS`` letters counts as a whole
word; a value whose words occur nowhere else is judged by length and marks; repeated rows give one row, repeated values
count as one length; empty tables give none; values of any length are read whole; other columns are ignored. A row with a
null source is judged with the lengths of all rows together.

Scale: each value is tokenised once. Trigrams are counted only where their first two words end some value, all others as
pairs, with sums in each task before the shuffle; where more than ``BROADCAST_PAIRS`` pairs of words end values (8 bytes
each in the broadcast), trigrams are counted first and then joined, so a frequent pair arrives as its distinct next words.
The rounds read one short row a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written

BROADCAST_PAIRS = 1_000_000
#: Lengths within LIMIT_NEAR of a length are its neighbours.
LIMIT_NEAR = 10
#: Rounds of expectation-maximization; occurrences a back-off weighs as much as; share of cuts apart from limits at first.
ROUNDS, BACK_OFF, FIRST_SHARE = 4, 1.0, 0.03
WORD_LETTERS = 64

_VALUES = r"""
select id, source_id, field_name, value, xxhash64(value) as print, length(value) as chars, octet_length(value) as bytes,
       case when field_name <> 'raw_text' then field_name when page then 'page' else 'text' end as kind, case when field_name = 'raw_html' then 'html' when field_name = 'raw_text' and page then 'page' else 'text' end as part
from (select id, source_id, raw_html is not null as page, stack(3, 'raw_title', raw_title, 'raw_text', raw_text, 'raw_html', raw_html) as (field_name, value) from {rows})
where id is not null and value is not null and trim(value) <> ''
"""

#: Words, sentence ends, brackets and symbols, digits alike; in raw_html tags, and '>' where text follows one. A mark at the end is no word.
_TOKENS = r"""
select *, if(field_name = 'raw_html', regexp_extract_all(value, '</?[a-zA-Z0-9!-]+|>(?=\\s*[^<\\s])', 0),
  regexp_extract_all(translate(lower(if(marked, regexp_replace(rest, '(?i)[\\s\\x{{FFFD}}]*(?:(?:\\.\\.+|…|\\[(?:\\.\\.\\.|…|truncated)\\])[\\s\\x{{FFFD}}]*)+$', ''), rest)), '123456789', '000000000'),
    '[#$@]?[\\p{{L}}\\p{{N}}]+|[.!?…\\n()»"”:;,]|\\p{{So}}', 0)) as words
from (select *, endswith(rest, '...') or endswith(rest, '…') or endswith(rest, ']') as marked from (select *, rtrim(' \n\t\r�', value) as rest from {values}))
"""

_ENDS = r"""
select *, xxhash64(part, w1, w2) as pair, xxhash64(part, w1, w2, w3) as k3, xxhash64(part, w2, w3) as k2, xxhash64(part, w3) as k1, w3 rlike '[\\p{{L}}\\p{{N}}]$' as bare,
       if(part = 'html', regexp_count(tags, '<(?!/|!|meta|br|img|hr|link|input|area|base|col|source|wbr)') - regexp_count(tags, '</'), 0) as opens
from (
  select id, source_id, field_name, kind, part, print, chars, bytes, endswith(rtrim(value), '�') as broken,
         case when marked and rest rlike '(?i)\\[(…|\\.\\.\\.|truncated)\\]$' then '[]' when endswith(rest, '...') then '...' when endswith(rest, '…') then '…'
              when part <> 'html' and (endswith(value, ' ') or endswith(value, '\t')) then ' ' else '' end as mark,
         if(part = 'html', lower(array_join(words, '')), '') as tags,
         coalesce(get(words, size(words) - 3), '^') as w1, coalesce(get(words, size(words) - 2), '^') as w2, coalesce(get(words, size(words) - 1), '^') as w3, size(words) as n_words, if(part = 'html', print, xxhash64(words)) as said
  from {tokens})
"""

_FLAT = r"""
select part, xxhash64(part, t.w1, t.w2) as pair, t.w1, t.w2, t.w3, t.w4 in ('.', '!', '?', '…', '\n') as stop
from (select part, explode(arrays_zip(w1, w2, w3, w4)) as t
      from (select part, concat(array('^', '^'), words) as w1, concat(array('^'), words) as w2, words as w3, slice(words, 2, size(words)) as w4 from {tokens} where size(words) > 1))
where t.w4 is not null
"""

#: For each wanted key (of a trigram, pair or word): how often it occurs inside as it stands, and as the beginning of longer words.
_INSIDE = r"""
with two as (select part, w2, w3, sum(n) as n, sum(n_stop) as n_stop from {grams} group by part, w2, w3),
one as (select part, w3, sum(n) as n, sum(n_stop) as n_stop from two group by part, w3),
spelled as (
  select 3 as level, part, w1, w2, w3, n, n_stop from {grams} where w1 is not null
  union all select 2, part, null, w2, w3, n, n_stop from two
  union all select 1, part, null, null, w3, n, n_stop from one),
begun as (
  select w3 = start as whole, n, n_stop, case level when 3 then xxhash64(part, w1, w2, start) when 2 then xxhash64(part, w2, start) else xxhash64(part, start) end as key
  from (select *, explode(if(length(w3) > {letters}, array(w3), transform(sequence(1, length(w3)), i -> left(w3, i)))) as start from spelled))
select key, sum(if(whole, n, 0)) as n_whole, sum(if(whole, 0, n)) as n_longer, sum(if(whole, n_stop, 0)) as n_stop
from begun left semi join {wanted} using (key) group by key
"""

#: How far a length stands out: the excess over the mean of its neighbours as odds; sources with few values lean on all sources.
_CROWDS = r"""
with own as (
  select *, sum(n) over (partition by source_id, field_name order by len range between {near} preceding and {near} following) - n -
         greatest(coalesce(max(n) over (partition by source_id, field_name order by len range between {near} preceding and 1 preceding), 0),
                  coalesce(max(n) over (partition by source_id, field_name order by len range between 1 following and {near} following), 0)) as around,
         max(len) over (partition by source_id, field_name) as longest
  from (select source_id, field_name, {kind} as len, count(distinct print) as n from {ends} group by source_id, field_name, {kind})),
whole as (
  select *, sum(n) over (partition by field_name order by len range between {near} preceding and {near} following) - n -
         greatest(coalesce(max(n) over (partition by field_name order by len range between {near} preceding and 1 preceding), 0),
                  coalesce(max(n) over (partition by field_name order by len range between 1 following and {near} following), 0)) as around,
         max(len) over (partition by field_name) as longest
  from (select field_name, {kind} as len, count(distinct print) as n from {ends} group by field_name, {kind})),
means as (
  select o.source_id, o.field_name, o.len, o.n, o.around / if(o.len = o.longest, {near}, 2 * {near}) as mean,
         w.n as n_all, w.around / if(w.len = w.longest, {near}, 2 * {near}) as mean_all
  from own o join whole w on w.field_name = o.field_name and w.len = o.len),
shared as (
  select *, greatest(n_all - mean_all - 2 * sqrt(mean_all + 1), 0) / (mean_all + 0.2) as odds_all from means)
select source_id, field_name, len,
       if(source_id is null, odds_all, greatest(n - mean - 2 * sqrt(mean + 1) + 0.2 * odds_all, 0) / (mean + 0.2)) as odds
from shared
"""

#: One row a value: what the rounds need.
_STATES = r"""
select e.id, e.source_id, e.field_name, e.kind, e.broken, e.k3, e.k2, e.k1, e.crowd, e.bare, c.copies,
       concat(if(e.field_name = 'raw_html', if(e.opens > coalesce(u.opens, 0), 'open', ''), e.mark), if(coalesce(i3.n_longer > 10 * i3.n_whole, i1.n_longer > 0 and i1.n_whole = 0, false), '~', '')) as mark,
       if(e.bare, coalesce(i3.n_stop, 0), 0) as stop3, if(e.bare, coalesce(i2.n_stop, 0), 0) as stop2, if(e.bare, coalesce(i1.n_stop, 0), 0) as stop1, 
       coalesce((2 * i3.n_whole + i3.n_longer) / 7, 0) as in3, coalesce((2 * i2.n_whole + i2.n_longer) / 7, 0) as in2, coalesce((2 * i1.n_whole + i1.n_longer) / 7, 0) as in1
from {ends} e
left join (select source_id, percentile_approx(opens, 0.5) as opens from {ends} where field_name = 'raw_html' group by source_id) u on u.source_id <=> e.source_id
join (select kind, said, count(*) as copies from {ends} group by kind, said) c on c.kind = e.kind and c.said = e.said
left join {inside} i3 on i3.key = e.k3
left join {inside} i2 on i2.key = e.k2
left join {inside} i1 on i1.key = e.k1
"""

#: Per kind of value: words (as many as if all values had the median, so that no giant decides) and sentence ends inside values like it.
_TOTALS = r"""
select kind, n_words, greatest(coalesce(n_stops, 0), 1) as n_stops
from (select kind, part, sum(n_words) over (partition by part) as n_words
      from (select kind, part, count(*) * percentile_approx(n_words, 0.5) as n_words from {ends} group by kind, part))
left join (select part, sum(n_stop) as n_stops from {grams} group by part) using (part)
"""

#: A round: ends and marks weighed by the last verdicts (``cut``, 0 to 1), then each value's odds anew. A value is no end of itself.
#: Its small tables are written first: the driver keeps every plan and re-plans it after each of its stages.
_BASE = r"""
with base as (
  select kind, sum(1 - cut) / (sum(1 - cut) + max(n_words)) as p0, greatest((sum(if(crowd < 1, cut, 0)) + 0.001) / (count_if(crowd < 1) + 0.1), 0.0005) as share
  from {last} join {totals} using (kind) group by kind),
styles as (
  select kind, sum(natural) / max(n_stops) as as_end
  from (select kind, k2, max(1 - cut) as natural from {last} where bare and stop2 > 0 group by kind, k2) join {totals} using (kind) group by kind)
select b.*, coalesce(s.as_end, 0) as as_end from base b left join styles s using (kind)
"""

_MARKS = r"""
with seen as (
  select source_id, field_name, crowd >= 1 as at, mark, sum(cut) as c, sum(1 - cut) as w from {last} group by source_id, field_name, crowd >= 1, mark),
everywhere as (
  select *, (c + 0.1) / (sum(c) over (partition by field_name, at) + 1) as pc, (w + 0.1) / (sum(w) over (partition by field_name, at) + 1) as pw
  from (select field_name, at, mark, sum(c) as c, sum(w) as w from seen group by field_name, at, mark))
select s.source_id, s.field_name, s.at, s.mark,
       ((s.c + 2 * e.pc) / (sum(s.c) over (partition by s.source_id, s.field_name, s.at) + 2)) /
       ((s.w + 2 * e.pw) / (sum(s.w) over (partition by s.source_id, s.field_name, s.at) + 2)) as times
from seen s join everywhere e on e.field_name = s.field_name and e.at = s.at and e.mark = s.mark
"""

_ROUND = r"""
with counted as (
  select kind, key, sum((1 - cut) / copies) as n from (select kind, cut, copies, stack(3, k3, k2, k1) as key from {last}) group by kind, key),
rates as (
  select l.*, b.p0, b.share, m.times, b.as_end * stop1 + greatest(c1.n - (1 - l.cut), 0) as end1, b.as_end * stop2 + greatest(c2.n - (1 - l.cut), 0) as end2,
         b.as_end * stop3 + greatest(c3.n - (1 - l.cut), 0) as end3
  from {last} l
  join {base} b on b.kind = l.kind
  join {marks} m on m.source_id <=> l.source_id and m.field_name = l.field_name and m.at = (l.crowd >= 1) and m.mark = l.mark
  join counted c3 on c3.kind = l.kind and c3.key = l.k3
  join counted c2 on c2.kind = l.kind and c2.key = l.k2
  join counted c1 on c1.kind = l.kind and c1.key = l.k1),
backed as (
  select *, (end1 + {k} * p0) / (end1 + in1 + {k}) as p1 from rates),
twice as (
  select *, (end2 + {k} * p1) / (end2 + in2 + {k}) as p2 from backed),
thrice as (
  select *, (end3 + {k} * p2) / (end3 + in3 + {k}) as p3 from twice),
odds as (
  select *, (crowd + share / (1 - share)) * times * (1 - p3) / p3 * p0 / (1 - p0) as odds from thrice)
select id, source_id, field_name, kind, broken, k3, k2, k1, crowd, bare, copies, mark, stop3, stop2, stop1, in3, in2, in1, if(broken, 1d, odds / (1 + odds)) as cut from odds
"""


def _crowds(ends: DataFrame, kind: str) -> DataFrame:
    return ends.sparkSession.sql(_CROWDS.replace("{near}", str(LIMIT_NEAR)).replace("{kind}", kind), ends=ends)


def _crowded(ends: DataFrame, kind: str, column: str) -> DataFrame:
    c = _crowds(ends, kind).select(F.col("source_id").alias("s"), F.col("field_name").alias("f"), "len", F.col("odds").alias(column))
    return ends.join(c, ends["source_id"].eqNullSafe(c["s"]) & (ends["field_name"] == c["f"]) & (ends[kind] == c["len"]), "left").drop("s", "f", "len")


def _grams(flat: DataFrame, ends: DataFrame) -> DataFrame:
    """(w1, w2, w3, n): counts of trigrams whose first two words end some value; the others with a null w1."""
    pairs = written(ends.select("pair").distinct(), "pairs")
    n = (F.count("*").alias("n"), F.count_if("stop").alias("n_stop"))
    if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        known = flat.join(F.broadcast(pairs.withColumn("known", F.lit(True))), "pair", "left")
        return known.groupBy(F.when(F.col("known"), F.col("w1")).alias("w1"), "part", "w2", "w3").agg(*n)
    known = flat.groupBy("part", "pair", "w1", "w2", "w3").agg(*n).join(pairs.withColumn("known", F.lit(True)), "pair", "left")
    return known.select(F.when(F.col("known"), F.col("w1")).alias("w1"), "part", "w2", "w3", "n", "n_stop")


def judged(rows: DataFrame) -> DataFrame:
    """(id, source_id, field_name, cut): every value with its verdict, the probability that it was cut."""
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), "source_id", "raw_title", "raw_text", "raw_html")
    tokens = spark.sql(_TOKENS, values=spark.sql(_VALUES, rows=rows))
    ends = written(spark.sql(_ENDS, tokens=tokens), "ends")
    grams = written(_grams(spark.sql(_FLAT, tokens=tokens), ends), "grams")
    wanted = ends.selectExpr("stack(3, k3, k2, k1) as key").distinct()
    inside = written(spark.sql(_INSIDE.replace("{letters}", str(WORD_LETTERS)), grams=grams, wanted=wanted), "inside")
    # Values at a limit in characters crowd at nearby numbers of bytes: these are counted without them.
    ends = written(_crowded(ends, "chars", "chars_odds"), "crowds")
    apart = _crowds(ends.filter("not chars_odds >= 2"), "bytes").select(F.col("source_id").alias("s"), F.col("field_name").alias("f"), "len", "odds")
    ends = ends.join(apart, ends["source_id"].eqNullSafe(apart["s"]) & (ends["field_name"] == apart["f"]) & (ends["bytes"] == apart["len"]), "left")
    ends = ends.withColumn("crowd", F.greatest(F.coalesce("chars_odds", F.lit(0.0)), F.when(F.col("chars_odds") >= 2, 0.0).otherwise(F.coalesce("odds", F.lit(0.0)))))
    totals = written(spark.sql(_TOTALS, ends=ends, grams=grams), "totals")
    ends = written(ends, "crowds")
    state = spark.sql(_STATES, ends=ends, inside=inside).withColumn("cut", F.expr(f"if(broken, 1d, if(endswith(mark, '~'), 0.99d, greatest(if(mark = 'open', 0.99d, 0d), (crowd + {FIRST_SHARE}) / (crowd + {FIRST_SHARE} + 1))))"))
    for _ in range(ROUNDS):
        state = written(state, "verdicts")
        base = written(spark.sql(_BASE, last=state, totals=totals), "base")
        marks = written(spark.sql(_MARKS, last=state), "marks")
        state = spark.sql(_ROUND.replace("{k}", str(BACK_OFF)), last=state, base=base, marks=marks)
    return state.groupBy("id", "source_id", "field_name").agg(F.max("cut").alias("cut"))


def cut_values(rows: DataFrame) -> DataFrame:
    """(raw_article_id, field_name) of the cut values."""
    return judged(rows).filter("cut > 0.5").select(F.col("id").alias("raw_article_id"), "field_name").distinct()


def cut_shares(rows: DataFrame) -> DataFrame:
    """(source_id, field_name, n, n_cut, share): how often each source cuts each field."""
    per = judged(rows).groupBy("source_id", "field_name").agg(F.count("*").alias("n"), F.count_if(F.col("cut") > 0.5).alias("n_cut"))
    return per.withColumn("share", F.col("n_cut") / F.col("n"))
