"""Queries over labels, tags, jobs and digests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import spread
from ..streaming import jobs
from .views import duck, view

Q, SQL = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


#: Tags and the fields that they stand for (fixed values of the binding to pages).
ALIASES = {"h1": "title", "title": "title", "p": "body", "article": "body", "a": "link", "li": "link", "div": "block", "nav": "block"}


def _aliases(spark):
    return F.broadcast(spark.createDataFrame(list(ALIASES.items()), "tag string, field string"))  # eight rows


@query
def tag_first_match(spark, d):
    """For each page and field the first tag that stands for it, in document order."""
    t = view(spark, d, "html_tags").withColumn("tag", S.local_name(F.col("tag"))).join(_aliases(spark), "tag")
    return t.groupBy("page_id", "field").agg(F.min_by("tag", "ord").alias("tag"), F.min("ord").alias("ord"))


ALIAS_SQL = "al as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES.items()) + ") v(tag, field))"
SQL["tag_first_match"] = duck(f"+{ALIAS_SQL} select page_id, field, arg_min(tag, ord) tag, min(ord)::bigint ord from html_tags join al using (tag) group by 1, 2", "html_tags")


@query
def alias_pivot(spark, d):
    t = view(spark, d, "html_tags").join(_aliases(spark), "tag")
    fields = sorted(set(ALIASES.values()))
    p = t.groupBy("page_id").pivot("field", fields).agg(F.count(F.lit(1)))
    return p.select("page_id", *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in fields])


SQL["alias_pivot"] = duck(f"+{ALIAS_SQL} select page_id, " + ", ".join(f"count(*) filter (field = '{f}') {f}" for f in sorted(set(ALIASES.values()))) + " from html_tags join al using (tag) group by 1", "html_tags")


@query
def key_ambiguity(spark, d):
    """Tags that a page repeats: reading them as one value is ambiguous."""
    t = view(spark, d, "html_tags").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return t.where("n > 1").select("page_id", "tag", "n")


SQL["key_ambiguity"] = duck("select page_id, tag, count(*) n from html_tags group by 1, 2 having count(*) > 1", "html_tags")


@query
def pointer_layout(spark, d):
    """Image offsets, row strides and end bytes from record counts, with what is wrong about them."""
    p = view(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_size").cast("bigint").alias("size"))
    unit = F.when(F.col("id") % 3 == 0, "BYTES").when(F.col("id") % 7 == 0, "FILE").otherwise("RECORDS")
    kind = F.element_at(F.array(*map(F.lit, ("u1", "i2", "u4", "f8"))), (F.col("id") % 4 + 1).cast("int"))
    item = F.element_at(F.create_map(F.lit("u1"), F.lit(1), F.lit("i2"), F.lit(2), F.lit("u4"), F.lit(4), F.lit("f8"), F.lit(8)), F.col("kind"))
    p = p.withColumns({"unit": unit, "kind": kind, "n": F.col("size") % 10 + 1, "rb": F.col("size") * 16, "w": F.col("id") % 100 + 1, "h": F.col("size") + 5})
    p = p.withColumn("offset", F.when(F.col("unit") == "RECORDS", (F.col("n") - 1) * F.col("rb")).when(F.col("unit") == "BYTES", F.col("n") - 1))
    p = p.withColumn("stride", F.col("w") * item + 4)
    p = p.withColumn("end_byte", F.col("offset") + F.col("h") * F.col("stride"))
    bad = S.violations((F.col("offset").isNull(), "pointer"), (F.col("end_byte") > F.col("rb") * 40, "short file"), (F.col("offset") < F.col("rb"), "inside label"))
    return p.select("id", "kind", "offset", "stride", "end_byte", F.concat_ws(";", bad).alias("reasons"))


SQL["pointer_layout"] = """with a as (select p_partkey::bigint id, p_size::bigint size from part),
b as (select *, case when id % 3 = 0 then 'BYTES' when id % 7 = 0 then 'FILE' else 'RECORDS' end unit, ['u1', 'i2', 'u4', 'f8'][id % 4 + 1] kind,
 [1, 2, 4, 8][id % 4 + 1] item, size % 10 + 1 n, size * 16 rb, id % 100 + 1 w, size + 5 h from a),
c as (select *, case unit when 'RECORDS' then (n - 1) * rb when 'BYTES' then n - 1 end "offset", w * item + 4 stride from b),
e as (select *, "offset" + h * stride end_byte from c)
select id, kind, "offset", stride, end_byte, concat_ws(';', case when "offset" is null then 'pointer' end, case when end_byte > rb * 40 then 'short file' end,
 case when "offset" < rb then 'inside label' end) reasons from e"""


@query
def label_precedence(spark, d):
    """Which of a scene's labels counts: a separate one before an attached one before the container, unless a mode forces one."""
    p = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    mode = F.element_at(F.array(*map(F.lit, ("auto", "attached", "separate", "none"))), (F.col("id") % 4 + 1).cast("int"))
    p = p.withColumn("mode", mode)
    separate = p.where("id % 2 = 0").select("id", (F.col("size") + 1).alias("w1"))
    attached = p.where("id % 3 = 0").select("id", (F.col("size") + F.when(F.col("id") % 5 == 0, 2).otherwise(1)).alias("w2"))
    j = p.join(separate, "id", "left").join(attached, "id", "left")
    has1, has2 = F.col("w1").isNotNull(), F.col("w2").isNotNull()
    route = (
        F.when((F.col("mode") == "attached") & has2, "attached").when((F.col("mode") == "separate") & has1, "separate").when(F.col("mode") == "none", "container")
        .when((F.col("mode") == "auto") & has1, "separate").when((F.col("mode") == "auto") & has2, "attached").when(F.col("mode") == "auto", "container")
    )
    conflict = has1 & has2 & ~F.col("w1").eqNullSafe(F.col("w2"))
    return j.select("id", "mode", route.alias("route"), conflict.alias("conflict"), F.when(route == "separate", F.col("w1")).when(route == "attached", F.col("w2")).otherwise(F.col("size")).alias("width"))


SQL["label_precedence"] = """with p as (select p_partkey id, p_size size, ['auto', 'attached', 'separate', 'none'][p_partkey % 4 + 1] mode from part),
j as (select p.*, s.w1, a.w2 from p left join (select id, size + 1 w1 from p where id % 2 = 0) s using (id) left join (select id, size + case when id % 5 = 0 then 2 else 1 end w2 from p where id % 3 = 0) a using (id)),
r as (select *, case when mode = 'attached' and w2 is not null then 'attached' when mode = 'separate' and w1 is not null then 'separate' when mode = 'none' then 'container'
 when mode = 'auto' and w1 is not null then 'separate' when mode = 'auto' and w2 is not null then 'attached' when mode = 'auto' then 'container' end route from j)
select id, mode, route, w1 is not null and w2 is not null and w1 <> w2 conflict, case route when 'separate' then w1 when 'attached' then w2 else size end width from r"""


@query
def missing_fields(spark, d):
    """Names of the fields that a record lacks, and its warnings without repeats."""
    o = view(spark, d, "orders")
    gone = F.filter(F.array(F.when(F.col("o_orderkey") % 2 == 0, "gsd"), F.when(F.col("o_orderkey") % 3 == 0, "incidence"), F.when(F.col("o_orderkey") % 5 == 0, "azimuth")), lambda x: x.isNotNull())
    warn = F.array_distinct(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus"))
    return o.select("o_orderkey", F.array_join(gone, ",").alias("missing"), F.array_join(warn, ",").alias("warnings"))


SQL["missing_fields"] = """select o_orderkey, concat_ws(',', case when o_orderkey % 2 = 0 then 'gsd' end, case when o_orderkey % 3 = 0 then 'incidence' end, case when o_orderkey % 5 = 0 then 'azimuth' end) missing,
 case when o_orderstatus = o_orderpriority then o_orderstatus else o_orderstatus || ',' || o_orderpriority end warnings from orders"""


@query
def artifact_names(spark, d):
    """Artifacts of finished jobs, by names that the allowed pattern takes."""
    o = view(spark, d, "orders")
    name = F.concat(F.lit("job-"), F.col("o_orderkey").cast("string"), F.element_at(F.array(*map(F.lit, (".tif", ".csv", ".json", "/../x"))), (F.col("o_custkey") % 4 + 1).cast("int")))
    a = o.select("o_orderkey", F.regexp_extract(name, r"^job-([0-9]+)\.(tif|csv|json)$", 2).alias("kind")).where("kind <> ''")
    return a.join(o.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_semi")


SQL["artifact_names"] = "select o_orderkey, ['tif', 'csv', 'json'][o_custkey % 4 + 1] kind from orders where o_custkey % 4 < 3 and o_orderstatus = 'F'"


@query
def digest_manifest(spark, d):
    """SHA-256 of each text and MD5 of bytes 11 to 60, as the manifest of its bytes."""
    t = view(spark, d, "documents").withColumn("b", F.coalesce("text", F.lit("")).cast("binary"))
    return t.select("doc_id", F.sha2("b", 256).alias("sha256"), F.md5(F.substring("b", 11, 50)).alias("md5"), F.octet_length("b").cast("bigint").alias("bytes"))


SQL["digest_manifest"] = """select doc_id, sha256(b) sha256, md5(unhex(substr(hex(b), 21, 100))) md5, octet_length(b)::bigint bytes from (select doc_id, encode(coalesce(text, '')) b from documents)"""


@query
def manifest_checks(spark, d):
    """Manifests as strict JSON, read back and compared with what they describe."""
    schema = "doc_id bigint, sha256 string, label string"
    t = view(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), F.base64(F.coalesce("source", F.lit("")).cast("binary")).alias("label"), F.coalesce("source", F.lit("")).alias("source"))
    t = t.withColumn("m", F.from_json(F.to_json(F.struct("doc_id", "sha256", "label")), schema, {"mode": "FAILFAST"}))
    return t.select("doc_id", F.col("m.sha256").alias("sha256"), F.unbase64("m.label").cast("string").alias("label"), (F.col("m.doc_id") == F.col("doc_id")).alias("own"))


SQL["manifest_checks"] = "select doc_id, sha256(encode(coalesce(text, ''))) sha256, coalesce(source, '') \"label\", true own from documents"


@query
def job_latest(spark, d):
    return jobs.latest(view(spark, d, "job_ev")).select("job", "kind", "event_id")


SQL["job_latest"] = duck("select job, arg_max(kind, (ts, event_id)) kind, arg_max(event_id, (ts, event_id)) event_id from job_ev group by 1", "job_ev")


@query
def job_claim(spark, d):
    """The one event that claims each job: the first `processing` after its first `queued`."""
    return jobs.claims(view(spark, d, "job_ev")).select("job", "event_id")


SQL["job_claim"] = duck("""+q as (select job, min((ts, event_id)) f from job_ev where kind = 'queued' group by 1)
select e.job, arg_min(event_id, (ts, event_id)) event_id from job_ev e join q on q.job = e.job and (ts, event_id) > f where kind = 'processing' group by 1""", "job_ev")


@query
def job_state(spark, d):
    """Each job's state after all its events, terminal states absorbing, progress only while processing."""
    return jobs.states(view(spark, d, "job_ev")).select("job", "status", "progress")


SQL["job_state"] = duck("""+q as (select job, min((ts, event_id)) f from job_ev where kind = 'queued' group by 1),
e as (select e.*, f from job_ev e join q on q.job = e.job and (ts, event_id) >= f),
c as (select job, min((ts, event_id)) c from e where kind = 'processing' group by 1),
t as (select job, min((ts, event_id)) t, arg_min(kind, (ts, event_id)) k from e where kind in ('complete', 'failed') group by 1),
s as (select q.job, c.c, t.t, t.k from q left join c using (job) left join t using (job)),
p as (select s.job, count(*) n from s join e using (job) where s.c is not null and e.kind = 'progress' and (e.ts, e.event_id) > s.c and (s.t is null or (e.ts, e.event_id) < s.t) group by 1)
select job, case when t is not null then k when c is not null then 'processing' else 'queued' end status,
 case when t is not null then 100 when c is not null then least(5 + 5 * coalesce(n, 0), 95) else 0 end::int progress from s left join p using (job)""", "job_ev")


def _short_jobs(spark, d):
    """The events dealt to so many jobs that each has a few only."""
    return view(spark, d, "job_ev").withColumn("job", F.col("event_id") % 4000)


SHORT = "je as (select event_id % 4000 job, ts, event_id, kind from job_ev)"


@query
def job_expire(spark, d):
    """Jobs without a terminal event whose last event is older than the limit at the end of the log."""
    return jobs.expired(_short_jobs(spark, d), 3600 * 24).select("job", "kind")


SQL["job_expire"] = duck(f"""+{SHORT}, l as (select job, max(ts) m, arg_max(kind, (ts, event_id)) kind, bool_or(kind in ('complete', 'failed')) done from je group by 1)
select job, kind from l where not done and m < (select max(ts) from je) - interval 86400 second""", "job_ev")


@query
def stage_deltas(spark, d):
    """Milliseconds from each event of a job to its next one."""
    t = spread.with_next(view(spark, d, "job_ev"), ["job"], ["ts", "event_id"], ["ts"])
    ms = (F.unix_micros(F.col("next.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000
    return t.select("job", "event_id", F.round(ms, 3).alias("ms"))


SQL["stage_deltas"] = duck("select job, event_id, round((epoch_us(lead(ts) over (partition by job order by ts, event_id)) - epoch_us(ts)) / 1000, 3) ms from job_ev", "job_ev")


@query
def job_sessions(spark, d):
    """Stretches of a job's events without a gap of an hour."""
    t = view(spark, d, "job_ev").withColumn("ts", F.col("ts").cast("timestamp"))
    s = t.groupBy("job", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return s.select("job", "n", "first_event")


SQL["job_sessions"] = duck("""+g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 3600000000 then 0 else 1 end b from job_ev window w as (partition by job order by ts)),
s as (select *, sum(b) over (partition by job order by ts rows unbounded preceding) s from g) select job, count(*) n, min(event_id) first_event from s group by job, s""", "job_ev")


@query
def retention(spark, d):
    """Jobs whose last event is older than five days at the end of the log: what a cleanup deletes."""
    return jobs.older_than(_short_jobs(spark, d), 5).select("job", "n")


SQL["retention"] = duck(f"+{SHORT}, l as (select job, max(ts) m, count(*) n from je group by 1) select job, n from l where m < (select max(ts) from je) - interval 5 day", "job_ev")
