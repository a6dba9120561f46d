"""The same results in plain SQL, for the queries SQL can express on whole tables."""

SQL = {
    "p4_found": """
with e as (select distinct processed_article_id r, entity_id i from article_entities where processed_article_id is not null and entity_id is not null),
n as (select count(distinct r) n from e),
c as (select i, count(*) c from e group by i),
p as (select x.i a, y.i b, count(*) n_ab from e x join e y on x.r = y.r and x.i < y.i group by 1, 2 having count(*) >= 5)
select p.a as entity_id_a, p.b as entity_id_b from p join c ca on ca.i = p.a join c cb on cb.i = p.b cross join n
where n_ab * n.n >= 5 * ca.c * cb.c""",
    "p4_pairs": """
with e as (select distinct processed_article_id r, entity_id i from article_entities where processed_article_id is not null and entity_id is not null),
c as (select i, count(*) c from e group by i),
p as (select x.i a, y.i b, count(*) n_ab from e x join e y on x.r = y.r and x.i < y.i group by 1, 2 having count(*) >= 5),
q as (select p.a, p.b, n_ab, ca.c as n_a, cb.c as n_b, (select count(distinct r) from e) as n from p join c ca on ca.i = p.a join c cb on cb.i = p.b),
o as (select *, (n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / (cast(n_a - n_ab as double) + 0.5) / (cast(n_b - n_ab as double) + 0.5) as odds from q where n_ab * n >= 5 * n_a * n_b)
select a, b, n_ab, n_a, n_b, n, round(cast(n_ab * n as double) / (n_a * n_b), 4) as lift, round(cast(odds as double), 4) as odds_ratio, round(ln(odds), 4) as log_odds from o""",
    "p7_found": r"""
with t as (select id, source_id, unnest(string_split(raw_text, chr(10))) line, generate_subscripts(string_split(raw_text, chr(10)), 1) line_no
           from raw_articles where source_id is not null),
k as (select id, source_id, line_no, lower(regexp_replace(line, '\P{L}+', '', 'g')) k from t),
n as (select source_id, count(distinct id) n from raw_articles where source_id is not null group by 1),
c as (select source_id, k, count(distinct id) c from k where k <> '' group by 1, 2)
select k.id as raw_article_id, cast(k.line_no as integer) as line_no from k join c using (source_id, k) join n using (source_id)
where c >= 5 and c >= 0.1 * n""",
    "p7_texts": r"""
with t as (select id, source_id, unnest(string_split(raw_text, chr(10))) line, generate_subscripts(string_split(raw_text, chr(10)), 1) line_no from raw_articles where raw_text is not null),
k as (select *, lower(regexp_replace(line, '\P{L}+', '', 'g')) k from t),
n as (select source_id, count(distinct id) n from raw_articles where source_id is not null group by 1),
c as (select k.source_id, k, true as hit from k join n using (source_id) where k <> '' group by k.source_id, k, n having count(distinct id) >= 5 and count(distinct id) >= 0.1 * n),
x as (select k.id, coalesce(string_agg(line, chr(10) order by line_no) filter (hit is null), '') as text from k left join c on c.source_id = k.source_id and c.k = k.k group by k.id)
select r.id, x.text from raw_articles r left join x using (id)""",
}
SQL["p7_increments"] = SQL["p7_found"]
