"""Entities, aliases and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import buckets, noise_class
from tidewire.operators import entities as ops
from tidewire.operators.store import assign_ids, delete_keys, keep_first, keep_last, upsert
from tidewire.session import table, written


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities")


def entity_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.entity_frequency(_entities(spark, sf_dir), table(spark, sf_dir, "article_entities"), 5)


def unaliased_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities of five articles or more no alias names."""
    left = ops.without_alias(_entities(spark, sf_dir), table(spark, sf_dir, "entity_aliases"))
    return ops.entity_frequency(left, table(spark, sf_dir, "article_entities"), 5).agg(F.count("*").alias("cnt"))


def link_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article_entities").groupBy("entity_id").agg(F.count("*").alias("links"))


def existing_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entity_aliases").filter("canonical_type <> 'discard'").select(F.lower("canonical_name").alias("name"), F.col("canonical_type").alias("type")).distinct()


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities an alias names exactly, by type where it has one."""
    a = table(spark, sf_dir, "entity_aliases").select(F.col("id").alias("alias_id"), "alias_name", "alias_type")
    e = _entities(spark, sf_dir).select(F.col("id").alias("entity_id"), "normalized_name", "type")
    return a.join(e, (a["alias_name"] == e["normalized_name"]) & (a["alias_type"].isNull() | (a["alias_type"] == e["type"]))).select("alias_id", "entity_id")


def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical name and type of every entity's original name; discards left out."""
    names = _entities(spark, sf_dir).filter("original_name is not null").select("id", F.col("original_name").alias("name"), "type")
    return ops.resolve_aliases(names, table(spark, sf_dir, "entity_aliases")).select("id", "canonical_name", "canonical_type")


def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target) of the entities that aliases merge, chains followed."""
    _, _, moves = ops.merge_by_aliases(_entities(spark, sf_dir), table(spark, sf_dir, "article_entities"), table(spark, sf_dir, "entity_aliases"))
    return moves


def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merge would do: (source, target, links), nothing changed."""
    return ops.merge_report(_entities(spark, sf_dir), table(spark, sf_dir, "article_entities"), table(spark, sf_dir, "entity_aliases"))


def created_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonicals under names that no entity has (each with a star): those that aliases of stored entities lead to, under new ids."""
    aliases = table(spark, sf_dir, "entity_aliases").withColumn("canonical_name", F.concat("canonical_name", F.lit(" *")))
    return ops.with_canonicals(_entities(spark, sf_dir), aliases).filter("created").select("id", "normalized_name", "type")


def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias table's names as mentions: which canonical entities they make, and which of them are new."""
    names = table(spark, sf_dir, "entity_aliases").filter("alias_type is not null").select(F.col("id").alias("seq"), F.col("alias_name").alias("name"), F.col("alias_type").alias("type"))
    return ops.upsert_entities(_entities(spark, sf_dir), names, table(spark, sf_dir, "entity_aliases")).select("normalized_name", "type", "original_name", "is_new")


def name_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities in chunks of 20 by type and name."""
    rows = _entities(spark, sf_dir).select("id", "type", "normalized_name")
    return ops.in_chunks(rows, [F.col("type"), F.col("normalized_name"), F.col("id")]).select("id", "chunk")


def ticker_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with tickers, braces, pictographs and loose ends put to them: the fault that is found first, and all of them."""
    e = _entities(spark, sf_dir)
    forms = F.array(F.concat(F.lit("$GAZP "), "normalized_name"), F.concat("normalized_name", F.lit(" $")), F.concat("normalized_name", F.lit(" {$SBER}")), F.concat("normalized_name", F.lit(" ☀")), F.concat(F.lit("<b>"), "normalized_name"), F.concat("normalized_name", F.lit(",")), F.concat(F.lit("«"), "normalized_name", F.lit("»")), F.lit("ABC_1"))
    rows = e.select("id", F.posexplode(forms).alias("form", "name"))
    return rows.select("id", "form", noise_class(F.col("name")).alias("noise"), F.array_join(buckets(F.col("name")), ",").alias("faults"))


def alias_merge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links after the merge: one per article and entity."""
    _, links, _ = ops.merge_by_aliases(_entities(spark, sf_dir), table(spark, sf_dir, "article_entities"), table(spark, sf_dir, "entity_aliases"))
    return links.select("id", "processed_article_id", "entity_id")


def alias_union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases and type fixes as one list: an alias wins over a fix of the same key."""
    a = table(spark, sf_dir, "entity_aliases").filter("alias_type is not null").select("alias_name", "alias_type", "canonical_name", "canonical_type", F.lit(0).alias("prio"), F.col("id").cast("long").alias("seq"))
    e = _entities(spark, sf_dir)
    fixes = e.filter("type = 'event'").select(F.col("normalized_name").alias("alias_name"), F.col("type").alias("alias_type"), F.col("normalized_name").alias("canonical_name"), F.lit("concept").alias("canonical_type"), F.lit(1).alias("prio"), F.col("id").alias("seq"))
    return keep_first(a.unionByName(fixes), ["alias_name", "alias_type"], [F.col("prio"), F.desc("seq")]).select("alias_name", "alias_type", "canonical_name", "canonical_type")


def null_safe_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd aliases are stored, all come in: the key (name, type) compares nulls as equal, the incoming canonical wins."""
    a = table(spark, sf_dir, "entity_aliases").select("id", "alias_name", "alias_type", "canonical_name")
    old = keep_last(a.filter("id % 2 = 1").withColumn("seq", F.col("id")), ["alias_name", "alias_type"], "seq").drop("seq")
    new = keep_last(a.withColumn("canonical_name", F.upper("canonical_name")).withColumn("seq", F.col("id")), ["alias_name", "alias_type"], "seq").drop("seq")
    return upsert(old.select(*a.columns), new.select(*a.columns), ["alias_name", "alias_type"], ["canonical_name"])


def delete_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links left after the discarded entities and theirs are gone."""
    gone = table(spark, sf_dir, "entity_aliases").filter("canonical_type = 'discard' and alias_name is not null and alias_type is not null").select(F.col("alias_name").alias("normalized_name"), F.col("alias_type").alias("type")).distinct()
    dead = _entities(spark, sf_dir).join(gone, ["normalized_name", "type"], "left_semi").select(F.col("id").alias("entity_id"))
    return delete_keys(table(spark, sf_dir, "article_entities"), dead, ["entity_id"]).groupBy("entity_id").agg(F.count("*").alias("links"))


def reference_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_per_type(entity_frequency(spark, sf_dir)).select("id", "type", "articles", "rank")


def tail_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of the list, in the order of the last word: what the sliding batches run over."""
    f = entity_frequency(spark, sf_dir)
    return f.join(ops.top_per_type(f).select("id"), "id", "left_anti").select("id", "normalized_name", ops.last_word(F.col("normalized_name")).alias("last_word"))


def sliding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent entity in overlapping windows of 80 by the order of its last word."""
    f = ops.entity_frequency(_entities(spark, sf_dir), table(spark, sf_dir, "article_entities"), 2)
    f = written(f.select(F.col("id").alias("entity"), ops.last_word(F.col("normalized_name")).alias("last"), F.lower("normalized_name").alias("low")), "frequent")
    none = spark.createDataFrame([], "n bigint")
    rows = assign_ids(none, f, "n", [F.col("last"), F.col("low"), F.col("entity")]).select(F.col("entity").alias("id"), (F.col("n") - 1).alias("i"))
    return ops.sliding_batches(rows, "i", f.count()).select("batch", "id")


def mention_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per article and entity: links, greatest importance, the first link's name and context."""
    e = table(spark, sf_dir, "article_entities").select("processed_article_id", "entity_id", "importance_score", F.col("entity_id").cast("string").alias("original_name"), "context_snippet", F.col("id").alias("start"))
    return ops.mention_rollup(e, ("processed_article_id", "entity_id"))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key sets of two readings of the articles: important and plain mentions."""
    e = table(spark, sf_dir, "article_entities")
    return ops.key_agreement(e.filter("importance_score >= 0.5"), e.filter("count >= 2"), ("processed_article_id", "entity_id"))


def partial_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.contained_names(_entities(spark, sf_dir).select(F.col("normalized_name").alias("name"), "type"))


def noise_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("id", F.coalesce(noise_class(F.col("normalized_name")), F.lit("none")).alias("noise"))


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("type", F.explode(buckets(F.col("normalized_name"))).alias("bucket")).groupBy("type", "bucket").agg(F.count("*").alias("cnt"))


QUERIES = {f.__name__: f for f in (entity_frequency, unaliased_count, link_count, existing_canonicals, entity_ids, alias_resolve, alias_merge, merge_report, created_canonicals, entity_upsert, name_chunks, ticker_classes, alias_merge_links, alias_union_priority, null_safe_upsert, delete_discards, reference_top_n, tail_set, sliding_batches, mention_rollup, agreement, partial_names, noise_classes, bucket_counts)}

_FREQ = "select e.id, e.normalized_name, e.type, count(distinct a.processed_article_id) as articles from entities e join article_entities a on a.entity_id = e.id group by 1, 2, 3 having count(distinct a.processed_article_id) >= "
_TOP = f"select *, row_number() over (partition by type order by articles desc, id) as rank from ({_FREQ}5) where type in ('person', 'organization', 'location')"
_MOVES = """
known as (
  select normalized_name as name, type from entities union
  select x.canonical_name, x.canonical_type from known k
  join entity_aliases x on x.alias_name = k.name and (x.alias_type is null or x.alias_type = k.type) and x.canonical_type <> 'discard' and x.canonical_name is not null),
fresh as (select * from known k where not exists (select 1 from entities e where e.normalized_name = k.name and e.type = k.type)),
every as (
  select id, normalized_name, type from entities
  union all select (select max(id) from entities) + row_number() over (order by name, type), name, type from fresh),
hit as (
  select e.id as source, d.target, x.alias_type, x.alias_name, x.id as aid from every e
  join entity_aliases x on x.alias_name = e.normalized_name and (x.alias_type is null or x.alias_type = e.type) and x.canonical_type <> 'discard'
  join (select normalized_name, type, min(id) as target from every group by 1, 2) d on d.normalized_name = x.canonical_name and d.type = x.canonical_type
  where d.target <> e.id),
pairs as (select source, target from (select *, row_number() over (partition by source order by alias_type is null, alias_name, aid) as rn from hit) where rn = 1),
chain as (select source, target, 1 as depth from pairs union all select c.source, p.target, c.depth + 1 from chain c join pairs p on p.source = c.target where c.depth < 50),
moves as (select source, target from chain where target not in (select source from pairs) and source <> target)"""
#: A letter of a pictograph by its number; a dollar sign and what follows it; edges by their first and last letter.
_SYMBOL = "list_bool_or(list_transform(string_split({0}, ''), lambda c: ord(c) between 9728 and 10175 or ord(c) between 126976 and 129791))"
_STARRED = "(select id, alias_name, alias_type, canonical_name || ' *' as canonical_name, canonical_type from entity_aliases) x"
_DOLLAR = r"(regexp_matches({0}, '\$[A-Z][0-9A-Z]') or regexp_matches({0}, '\$\s*$') or regexp_matches({0}, '[{{]\$[^}}]+[}}]'))"
_LOOSE = r"({0} <> '' and not regexp_matches({0}, '^[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}«]') or {0} <> '' and not regexp_matches(right({0}, 1), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}»]'))"
_BRACKET = "translate({0}, '<>{{}}', '') <> {0}"
_FIRST_FAULT = f"""case when {_DOLLAR} then 'ticker' when {_SYMBOL} then 'emoji' when {_BRACKET} then 'html_artifact'
  when length(replace({{0}}, ' ', '')) < 3 then 'too_short' when {_LOOSE} then 'punct_edge' end"""
_FAULTS = f"""list_filter([case when {_DOLLAR} then 'A_ticker' end, case when {_SYMBOL} then 'A_emoji' end, case when {_BRACKET} then 'A_html_artifact' end,
  case when regexp_full_match({{0}}, '[A-Z]\\w+') and upper({{0}}) = {{0}} then 'A_caps_latin' end, case when {_LOOSE} then 'A_punct_edge' end,
  case when length(replace({{0}}, ' ', '')) < 3 then 'B_too_short' end,
  case when lower({{0}}) = {{0}} and regexp_matches({{0}}, '[А-Яа-яЁё]') then 'B_lower_case' end], lambda x: x is not null)"""
SQL = {
    "entity_frequency": _FREQ + "5",
    "unaliased_count": """
select count(*) as cnt from (select e.id from entities e join article_entities a on a.entity_id = e.id
where not exists (select 1 from entity_aliases x where lower(x.alias_name) = lower(e.normalized_name) and (e.type = x.alias_type or x.alias_type is null))
group by 1 having count(distinct a.processed_article_id) >= 5)""",
    "link_count": "select entity_id, count(*) as links from article_entities group by 1",
    "existing_canonicals": "select distinct lower(canonical_name) as name, canonical_type as type from entity_aliases where canonical_type <> 'discard'",
    "entity_ids": "select a.id as alias_id, e.id as entity_id from entity_aliases a join entities e on a.alias_name = e.normalized_name and (a.alias_type is null or a.alias_type = e.type)",
    "alias_resolve": """
with m as (
  select e.id, e.original_name, e.type, a.canonical_name, a.canonical_type,
    row_number() over (partition by e.id order by a.alias_type is null, a.alias_name, a.id) as rn
  from entities e left join entity_aliases a on lower(a.alias_name) = lower(e.original_name) and (a.alias_type = e.type or a.alias_type is null)
  where e.original_name is not null),
r as (select id, translate(coalesce(canonical_name, substr(original_name, 1, 500)), 'ёЁ', 'еЕ') as n, coalesce(canonical_type, type) as canonical_type from m where rn = 1)
select id, upper(substr(n, 1, 1)) || substr(n, 2) as canonical_name, canonical_type from r where canonical_type <> 'discard'""",
    "alias_merge": f"with recursive {_MOVES} select distinct source, target from moves",
    "merge_report": f"""with recursive {_MOVES}
select m.source, m.target, count(a.id) as links from (select distinct source, target from moves) m left join article_entities a on a.entity_id = m.source group by 1, 2""",
    "created_canonicals": f"with recursive {_MOVES.replace('entity_aliases x', _STARRED)} select id, normalized_name, type from every where id > (select max(id) from entities)",
    "entity_upsert": """
with m as (
  select x.id, x.alias_name as name, x.alias_type as type, a.canonical_name, a.canonical_type,
    row_number() over (partition by x.id order by a.alias_type is null, a.alias_name, a.id) as rn
  from entity_aliases x left join entity_aliases a on lower(a.alias_name) = lower(x.alias_name) and (a.alias_type = x.alias_type or a.alias_type is null)
  where x.alias_type is not null),
r as (select id, name, translate(coalesce(canonical_name, substr(name, 1, 500)), 'ёЁ', 'еЕ') as n, coalesce(canonical_type, type) as type from m where rn = 1),
k as (select id, name, upper(substr(n, 1, 1)) || substr(n, 2) as normalized_name, type from r where type <> 'discard'),
f as (select *, row_number() over (partition by normalized_name, type order by id) as rn from k)
select f.normalized_name, f.type, f.name as original_name, not exists (select 1 from entities e where e.normalized_name = f.normalized_name and e.type = f.type) as is_new from f where rn = 1""",
    "name_chunks": "select id, (row_number() over (order by type, normalized_name, id) - 1) // 20 as chunk from entities",
    "ticker_classes": f"""
with f as (select id, unnest([{{'form': 0, 'name': '$GAZP ' || normalized_name}}, {{'form': 1, 'name': normalized_name || ' $'}}, {{'form': 2, 'name': normalized_name || ' {{$SBER}}'}},
  {{'form': 3, 'name': normalized_name || ' ☀'}}, {{'form': 4, 'name': '<b>' || normalized_name}}, {{'form': 5, 'name': normalized_name || ','}},
  {{'form': 6, 'name': '«' || normalized_name || '»'}}, {{'form': 7, 'name': 'ABC_1'}}], recursive := true) from entities)
select id, cast(form as integer) as form, {_FIRST_FAULT.format('name')} as noise, array_to_string({_FAULTS.format('name')}, ',') as faults from f""",
    "alias_merge_links": f"""with recursive {_MOVES},
moved as (select a.id, a.processed_article_id, coalesce(m.target, a.entity_id) as entity_id, m.target is not null as moved from article_entities a left join (select distinct * from moves) m on m.source = a.entity_id)
select id, processed_article_id, entity_id from (select *, row_number() over (partition by processed_article_id, entity_id order by moved, id) as rn from moved) where rn = 1""",
    "alias_union_priority": """
with u as (
  select alias_name, alias_type, canonical_name, canonical_type, 0 as prio, cast(id as bigint) as seq from entity_aliases where alias_type is not null
  union all select normalized_name, type, normalized_name, 'concept', 1, id from entities where type = 'event')
select alias_name, alias_type, canonical_name, canonical_type from (select *, row_number() over (partition by alias_name, alias_type order by prio, seq desc) as rn from u) where rn = 1""",
    "null_safe_upsert": """
with l as (select *, row_number() over (partition by alias_name, alias_type order by id desc) as rn from entity_aliases),
o as (select *, row_number() over (partition by alias_name, alias_type order by id desc) as rn from entity_aliases where id % 2 = 1)
select coalesce(o.id, l.id) as id, l.alias_name, l.alias_type, upper(l.canonical_name) as canonical_name
from (select * from l where rn = 1) l left join (select * from o where rn = 1) o on o.alias_name is not distinct from l.alias_name and o.alias_type is not distinct from l.alias_type""",
    "delete_discards": """
select entity_id, count(*) as links from article_entities where entity_id not in (
  select e.id from entities e where exists (select 1 from entity_aliases a where a.canonical_type = 'discard' and a.alias_name = e.normalized_name and a.alias_type = e.type)) group by 1""",
    "reference_top_n": f"select id, type, articles, rank from ({_TOP}) where rank <= 50",
    "tail_set": rf"""select id, normalized_name, lower(regexp_extract(trim(normalized_name), '(\S+)$', 1)) as last_word from ({_FREQ}5)
where id not in (select id from ({_TOP}) where rank <= 50)""",
    "sliding_batches": rf"""
with f as ({_FREQ}2),
r as (select id, row_number() over (order by lower(regexp_extract(trim(normalized_name), '(\S+)$', 1)) collate c, lower(normalized_name) collate c, id) - 1 as i, count(*) over () as n from f),
b as (select *, unnest(range(0, 100000)) as batch from (select * from r where false) union all
      select r.*, g.batch from r join (select unnest(range(0, cast((select count(*) from f) / 50 + 2 as bigint))) as batch) g
      on g.batch * 50 <= r.i and r.i < g.batch * 50 + 80)
select cast(batch as integer) as batch, id from b where batch <= case when n <= 80 then 0 else cast(ceil((n - 80) / 50.0) as bigint) end""",
    "mention_rollup": """
select processed_article_id, entity_id, count(*) as count, max(importance_score) as importance_score, cast(entity_id as varchar) as original_name,
  (min_by(struct_pack(c := context_snippet), id)).c as context_snippet
from article_entities group by 1, 2""",
    "agreement": """
with l as (select distinct processed_article_id, entity_id from article_entities where importance_score >= 0.5), r as (select distinct processed_article_id, entity_id from article_entities where count >= 2)
select (select count(*) from (select * from l intersect select * from r)) as common, (select count(*) from (select * from l except select * from r)) as left_only,
  (select count(*) from (select * from r except select * from l)) as right_only""",
    "partial_names": r"""
with n as (select distinct normalized_name as n, type from entities), w as (select n, type, regexp_split_to_array(lower(trim(n)), '\s+') as ws from n),
l as (select n as long, type, unnest(list_distinct(ws)) as w from w where len(list_distinct(ws)) > 1), s as (select n as short, type, ws[1] as w from w where len(list_distinct(ws)) = 1)
select distinct s.short, l.long, s.type from s join l using (w, type)""",
    "noise_classes": f"select id, coalesce({_FIRST_FAULT.format('normalized_name')}, 'none') as noise from entities",
    "bucket_counts": f"""
with b as (select type, unnest({_FAULTS.format('normalized_name')}) as bucket from entities)
select type, bucket, count(*) as cnt from b group by 1, 2""",
}
