"""Registered queries of the inventory engine and, for each, the same rows in DuckDB SQL.

The driver's tables hold no file tree; the queries run over inventories derived from the
whole of ``documents`` and ``events`` (``sources/tables.py``), the SQL over the same
derivation written as CTEs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafold.functions import hashing, paths, sizes
from stratafold.operators import clusters as C
from stratafold.operators import duplicates, legacy, similarity, snapshot, tree, waste
from stratafold.operators.ordering import with_running
from stratafold.plans import artifacts, matching, proposals
from stratafold.scratch import materialize
from stratafold.sources.tables import cluttered_inventory, inventory, table, timed_folders

CAP, SIMILAR, CLUSTER, MERGE = 100, 0.2, 0.70, 0.88
ROOTS = ["D:/corpus", "E:/corpus", "F:/archive"]
THRESHOLDS = [("D:/corpus", 4000), ("E:/corpus/src3", 1000), ("E:/corpus", 8000)]

# ---------------------------------------------------------------- shared SQL

INV = """base as (select doc_id, 'doc_' || doc_id || '.' || lang as filename, n_chars as size, md5(text) as h, source, lang,
  cast(substr(source, 4) as int) as sn from documents),
fs as (select 'D:/corpus/' || source || '/' || lang as folder, filename, size, h from base
  union all select 'E:/corpus/' || source || case when sn % 2 = 0 then '_backup' else '' end || '/' || lang, filename, size, h from base
    where doc_id % (2 + sn) <> 0 and sn % 5 <> 4
  union all select 'F:/archive/' || source || '/' || lang, filename, size, h from base where sn % 3 = 0 and doc_id % (5 + sn) <> 0),
f as materialized (select folder, filename, folder || '/' || filename as path, size, h from fs)"""
PREFIX = "array_to_string(list_slice(string_split({p}, '/'), 1, i), '/')"
UP = f"""up as materialized (select *, {PREFIX.format(p="folder")} as anc from (select *, unnest(range(2, len(string_split(folder, '/')) + 1)) as i from f))"""
FOLD = f"""fd as (select distinct {PREFIX.format(p="folder")} as path from (select distinct folder, unnest(range(2, len(string_split(folder, '/')) + 1)) as i from f)),
fo as materialized (select path, case when len(string_split(path, '/')) > 2 then regexp_replace(path, '/[^/]*$', '') end as parent,
  upper(substr(path, 1, 2)) as drive, len(string_split(path, '/')) - 2 as depth, coalesce(n, 0) as file_count, coalesce(b, 0) as total_bytes,
  cast(coalesce(b, 0) % 1009 as double) as mtime
  from fd left join (select folder, count(*) as n, sum(size) as b from f group by folder) on folder = path)"""
GROUPS = "g as (select h as full_hash, size as size_bytes, count(*) as file_count, count(*) * size as total_bytes from f group by h, size having count(*) > 1)"
KEYS = """k as materialized (select distinct anc as folder, 's' as kind, lower(filename) || '|' || size as key from up
  union all select distinct anc, 'h', h from up join g on h = full_hash and size = size_bytes)"""
PAIRS = f"""useful as (select kind, key from k group by kind, key having count(*) between 2 and {CAP}),
held as materialized (select k.* from k join useful using (kind, key)),
p as materialized (select distinct a.folder as folder_a, b.folder as folder_b from held a join held b using (kind, key)
  where a.folder < b.folder and not starts_with(b.folder, a.folder || '/'))"""
_LAST = "lower(list_extract(string_split({}, '/'), -1))"
_BACK = "({0} like '%backup%' or {0} like '%copy%' or {0} like '%old%' or {0} like '%temp%')"
SCORES = f"""tot as (select anc, count(*) as n, sum(size) as b from up group by anc),
cnt as (select folder, count(*) filter (kind = 's') as s, count(*) filter (kind = 'h') as h from k group by folder),
pr as (select folder_a, folder_b, least(a.n, b.n) / greatest(a.n, b.n) as file_count_ratio,
  case when a.b > 0 and b.b > 0 then least(a.b, b.b) / greatest(a.b, b.b) else 0.0 end as size_ratio
  from p join tot a on a.anc = folder_a join tot b on b.anc = folder_b),
sh as (select folder_a, folder_b, count(*) filter (a.kind = 's') as s, count(*) filter (a.kind = 'h') as h
  from pr join k a on a.folder = folder_a join k b on b.folder = folder_b and a.kind = b.kind and a.key = b.key
  where file_count_ratio >= 0.2 and size_ratio >= 0.2 group by folder_a, folder_b),
sc0 as (select folder_a, folder_b, file_count_ratio, size_ratio, sh.s as shared_signatures, sh.h as shared_duplicate_files,
  case when {_BACK.format(_LAST.format("folder_a"))} or {_BACK.format(_LAST.format("folder_b"))} then 0.2::double else 0.0::double end as name_bonus,
  case when x.h + y.h - sh.h > 0 then sh.h / (x.h + y.h - sh.h) else 0.0 end as jh,
  case when x.s + y.s - sh.s > 0 then sh.s / (x.s + y.s - sh.s) else 0.0 end as js
  from pr join sh using (folder_a, folder_b) join cnt x on x.folder = folder_a join cnt y on y.folder = folder_b),
sc as materialized (select *, 0.55::double * jh + 0.35::double * js + 0.10::double * name_bonus as score,
  'shared_duplicate_files=' || shared_duplicate_files || ', shared_signatures=' || shared_signatures || ', name_bonus=' || case when name_bonus > 0 then '0.20' else '0.00' end as reason
  from sc0 where 0.55::double * jh + 0.35::double * js + 0.10::double * name_bonus >= {SIMILAR}),
tr as materialized (select *, case when score >= {MERGE} and name_bonus > 0 then 'backup' when score >= {CLUSTER} then 'cluster' else 'review' end as track from sc)"""
CLUST = """e as materialized (select folder_a as a, folder_b as b from tr where track = 'cluster' union select folder_b, folder_a from tr where track = 'cluster'),
reach as (select a as node, a as other from e union select node, e.b from reach join e on reach.other = e.a),
comp as (select node, min(other) as component from reach group by node),
num as (select component, printf('cluster-%04d', row_number() over (order by component)) as cluster_id from (select distinct component from comp)),
cm as materialized (select cluster_id, node as path from comp join num using (component)),
ms as materialized (select cluster_id, min(score) as min_score from tr join cm on cm.path = folder_a where track = 'cluster' group by cluster_id)"""
MASTER = """ma as materialized (select cluster_id, path, coalesce(file_count, 0) as file_count, coalesce(total_bytes, 0) as total_bytes,
  row_number() over (partition by cluster_id order by case when starts_with(path, 'D:/corpus/') or path = 'D:/corpus' then 0
    when starts_with(path, 'E:/corpus/') or path = 'E:/corpus' then 1 when starts_with(path, 'F:/archive/') or path = 'F:/archive' then 2 else 3 end,
    coalesce(file_count, 0) desc, coalesce(depth, 9999), coalesce(mtime, 0.0) desc, path) = 1 as is_master
  from cm left join fo using (path))"""
SUPP = """ab as (select cluster_id, path, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as anc
  from (select *, unnest(range(1, len(string_split(path, '/')))) as i from cm)),
met as (select ab.cluster_id, c.cluster_id as by_id, count(distinct ab.path) as n from ab join cm c on c.path = anc where c.cluster_id <> ab.cluster_id group by all),
su as materialized (select distinct met.cluster_id from met join (select cluster_id, count(*) as size from cm group by cluster_id) z using (cluster_id) where n = size)"""
UNIQ = """mf as materialized (select m.cluster_id, m.path as copy, m.is_master, u.path, u.size, {h} as h from {m} m join up u on u.anc = m.path),
mh as materialized (select distinct cluster_id, h as known from mf where is_master and h is not null),
uq as materialized (select mf.cluster_id, copy, path, size, h from mf left join mh on mh.cluster_id = mf.cluster_id and known = h where not is_master and known is null)"""
TO_SCORES = ",\n".join([INV, UP, GROUPS, KEYS, PAIRS, SCORES])
TO_CLUSTERS = ",\n".join([TO_SCORES, FOLD, CLUST])
TO_MASTERS = ",\n".join([TO_CLUSTERS, MASTER])


def _with(ctes: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes}\n{body}"


# ---------------------------------------------------------------- shared frames


def _keys(spark, d):
    return similarity.folder_keys(inventory(spark, d))


def _merged(files):
    return materialize(similarity.merged_keys(materialize(similarity.folder_keys(files), "keys")), "merged")


def _files(spark, d):
    """The inventory, written once: its hashes read every text."""
    return materialize(inventory(spark, d), "files")


def _scored(spark, d, files=None):
    files = _files(spark, d) if files is None else files
    keys = _merged(files)
    pairs = materialize(similarity.candidate_pairs(keys, CAP), "pairs")
    return similarity.scores(pairs, keys, tree.subtree_totals(files), SIMILAR)


def _tracked(spark, d, files=None):
    return materialize(similarity.tracks(_scored(spark, d, files), MERGE, CLUSTER), "tracked")


def _clustered(spark, d, files=None):
    pairs = _tracked(spark, d, files).filter("track = 'cluster'")
    return materialize(C.clusters(pairs), "clusters"), pairs


def _mastered(spark, d, files=None):
    files = _files(spark, d) if files is None else files
    members, pairs = _clustered(spark, d, files)
    return materialize(C.masters(members, timed_folders(files), ROOTS), "masters"), members, pairs


def _hashed(files):
    return files.withColumnRenamed("h", "full_hash")


QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


# ---------------------------------------------------------------- sources, filters, totals


@query(_with(INV, "select folder, path, size, case when size >= 2000 then h end as full_hash from f where size >= 500 and hash(1) is not null and not (length(filename) % 5 = 0)"))
def active_files(spark, d):
    files = inventory(spark, d).withColumn("is_missing", F.length("filename") % 5 == 0)
    hashes = inventory(spark, d).filter("size >= 2000").select("path", F.col("h").alias("full_hash"))
    dirs = timed_folders(inventory(spark, d)).withColumn("is_missing", F.lit(False))
    return tree.active_files(files, dirs, hashes, 500).select("folder", "path", "size", "full_hash").orderBy("path")


@query(_with(f"{INV},\n{FOLD}", "select path, parent, drive, cast(depth as bigint) as depth, cast(file_count as bigint) as file_count, cast(total_bytes as bigint) as total_bytes from fo"))
def active_folders(spark, d):
    return timed_folders(inventory(spark, d)).withColumn("depth", F.col("depth").cast("long")).drop("mtime").orderBy("depth", "path")


@query(_with(INV, "select folder, count(*) as files, cast(sum(size) as bigint) as bytes from f group by folder"))
def folder_totals(spark, d):
    return inventory(spark, d).groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(_with(f"{INV},\n{UP}", "select anc as folder, count(*) as files, cast(sum(size) as bigint) as bytes from up group by anc"))
def subtree_totals(spark, d):
    return tree.subtree_totals(inventory(spark, d)).select(F.col("ancestor").alias("folder"), F.col("total_files").alias("files"), F.col("total_bytes").alias("bytes"))


@query(_with(INV, "select folder, filename, size from f where size >= 300 and size <= 20000 and not filename like '%.es' and folder not like '%/src7/%' and folder not like '%/src7'"))
def allowed_files(spark, d):
    return tree.allowed(inventory(spark, d), folders_out=("src7",), suffixes_out=(".es",), least=300, most=20000).select("folder", "filename", "size")


@query(_with(f"{INV},\n{UP}", "select path, size from f where starts_with(folder, 'D:/corpus/src3/') or folder = 'D:/corpus/src3'"))
def subtree_files(spark, d):
    return inventory(spark, d).filter(paths.under(F.col("folder"), F.lit("D:/corpus/src3"))).select("path", "size")


_SUFFIX = "select regexp_replace(folder, '/[^/]*$', '') as folder, lower(regexp_extract(filename, '.([.][^.]+)$', 1)) as suffix, count(*) as files from f group by 1, 2"


@query(_with(f"{INV},\nc as ({_SUFFIX})", "select * from (select *, row_number() over (partition by folder order by files desc, suffix) as place from c) where place <= 5"))
def suffix_top5(spark, d):
    files = inventory(spark, d).withColumn("folder", paths.parent(F.col("folder")))
    return tree.top_suffixes(files)


_LARGE = "select distinct path, size from f, (values " + ", ".join(f"('{r}', {n})" for r, n in THRESHOLDS) + ") as t(root, least) where (starts_with(folder, root || '/') or folder = root) and size >= least"


@query(_with(INV, _LARGE))
def large_files(spark, d):
    thresholds = spark.sql("select * from values " + ", ".join(f"('{r}', {n}L)" for r, n in THRESHOLDS) + " as t(root, threshold)")
    return tree.large_files(inventory(spark, d), thresholds).orderBy(F.desc("size"), "path")


@query(_with(INV, f"select count(*) as files, cast(coalesce(sum(size), 0) as bigint) as bytes from ({_LARGE})"))
def large_totals(spark, d):
    return tree.marked_totals(large_files(spark, d))


@query(_with(INV, f"select count(*) as files, cast(coalesce(sum(size), 0) as bigint) as bytes from ({_LARGE}) where size % 2 = 0 and path like 'D:%'"))
def large_marked(spark, d):
    """What the files marked in a review of the largest come to."""
    return tree.marked_totals(large_files(spark, d), inventory(spark, d).filter("size % 2 = 0 and path like 'D:%'"))


@query(_with(f"{INV},\n{GROUPS},\n{FOLD}", "select (select count(*) from fo) as folders, (select count(*) from f) as files, (select count(*) from g) as groups"))
def active_counts(spark, d):
    files = inventory(spark, d)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(tree.folders(files), "folders").crossJoin(one(files, "files")).crossJoin(one(duplicates.groups(files), "groups"))


@query(
    "select distinct event_type as kind, 'p' || user_id as path, 'm' || (event_id % 3) as message from events where event_id % 7 not in (2, 3, 5)"
)
def scan_errors(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("kind"), F.concat(F.lit("p"), "user_id").alias("path"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("message"), (F.col("event_id") % 7).alias("code")
    )
    return tree.distinct_errors(rows)


# ---------------------------------------------------------------- paths and sizes

_URLS = "select page_id, url, string_split(regexp_replace(regexp_replace(url, '[\\\\/]+', '/', 'g'), '/$', ''), '/') as s, regexp_replace(regexp_replace(url, '[\\\\/]+', '/', 'g'), '/$', '') as p from pages"


@query(
    f"""select page_id, p as path, s[-1] as name, case when contains(p, '/') then regexp_replace(p, '/[^/]*$', '') end as parent, cast(len(s) as bigint) as parts,
  lower(regexp_extract(s[-1], '.([.][^.]+)$', 1)) as suffix, array_to_string(list_slice(s, 1, 2), '/') as top,
  case when length(p) > 40 then '...' || right(p, 37) else p end as short, regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g') as safe from ({_URLS})"""
)
def path_functions(spark, d):
    p = F.col("path")
    return table(spark, d, "pages").withColumn("path", paths.normalise(F.col("url"))).select(
        "page_id", "path", paths.name(p).alias("name"), paths.parent(p).alias("parent"), paths.n_parts(p).cast("long").alias("parts"),
        paths.suffix(paths.name(p)).alias("suffix"), F.element_at(paths.ancestors(p, 2), 1).alias("top"),
        paths.shortened(p, 40, 37).alias("short"), paths.safe_filename(F.col("url")).alias("safe"),
    )


@query(
    """select doc_id, cast(floor(n_chars * case doc_id % 4 when 0 then 1 when 1 then 1024 when 2 then 1048576 else 1073741824 end) as bigint) as bytes,
  case when n_chars * (1024 ** 2) >= 1024 ** 3 then printf('%.1f GB', n_chars / 1024.0) else printf('%.1f MB', cast(n_chars as double)) end as human from documents"""
)
def size_functions(spark, d):
    unit = F.element_at(F.array(*map(F.lit, (" B", "kb", " MB", "GB"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", sizes.size_of(F.concat(F.col("n_chars").cast("string"), unit)).cast("long").alias("bytes"), sizes.human(F.col("n_chars") * 1024 * 1024).alias("human")
    )


# ---------------------------------------------------------------- duplicates


@query(_with(f"{INV},\n{GROUPS}", "select full_hash, size_bytes, file_count, cast(total_bytes as bigint) as total_bytes from g"))
def dup_groups(spark, d):
    return duplicates.groups(inventory(spark, d))


@query(_with(f"{INV},\n{GROUPS}", "select full_hash, size_bytes, f.folder, f.path from f join g on h = full_hash and size = size_bytes"))
def dup_members(spark, d):
    files = inventory(spark, d)
    return duplicates.members(files, duplicates.groups(files))


_FUNNEL = """a as (select *, substr(h, 1, 8) as q from f where size >= 2000),
b as (select *, count(*) over (partition by size) as c from a), b2 as (select * exclude (c) from b where c > 1),
c as (select *, count(*) over (partition by size, q) as c from b2), c2 as (select * exclude (c) from c where c > 1),
e as (select *, count(*) over (partition by size, q, h) as c from c2), e2 as (select * from e where c > 1)"""


@query(
    _with(
        f"{INV},\n{_FUNNEL}",
        "select 'eligible' as stage, count(*) as n from a union all select 'same_size', count(*) from b2 union all select 'same_quick', count(*) from c2 "
        "union all select 'same_full', count(*) from e2 union all select 'groups', count(*) from (select distinct size, q, h from e2)",
    )
)
def dup_funnel_counts(spark, d):
    return duplicates.funnel_counts(inventory(spark, d).withColumn("q", F.substring("h", 1, 8)), "q", "h", 2000)


@query(
    _with(
        f"{INV},\n{_FUNNEL}",
        "select f.path, b2.q as quick_hash, c2.h as full_hash from f left join b2 using (path) left join c2 using (path)",
    )
)
def dup_funnel_hashes(spark, d):
    files = materialize(inventory(spark, d), "files")
    look = lambda column: lambda asked: asked.join(files.select("path", "h"), "path").select("path", column.alias("digest"))
    return duplicates.funnel(files, look(F.substring("h", 1, 8)), look(F.col("h")), 2000)


# ---------------------------------------------------------------- similarity


@query(_with(",\n".join([INV, UP, GROUPS, KEYS]), "select folder, count(*) filter (kind = 's') as signatures, count(*) filter (kind = 'h') as hashes from k group by folder"))
def folder_signatures(spark, d):
    return similarity.key_counts(_keys(spark, d))


@query(_with(",\n".join([INV, UP, GROUPS, KEYS, PAIRS]), "select folder_a, folder_b from p"))
def candidate_pairs(spark, d):
    return similarity.candidate_pairs(_merged(_files(spark, d)), CAP)


@query(_with(",\n".join([INV, UP, GROUPS, KEYS, PAIRS.replace(f"and {CAP}", "and 8")]), "select folder_a, folder_b from p"))
def candidate_pairs_low_cap(spark, d):
    return similarity.candidate_pairs(_merged(_files(spark, d)), 8)


_SCORE_COLUMNS = "folder_a, folder_b, round(score, 6) as score, shared_duplicate_files, shared_signatures, name_bonus, round(size_ratio, 6) as size_ratio, round(file_count_ratio, 6) as file_count_ratio, reason"


@query(_with(TO_SCORES, f"select {_SCORE_COLUMNS} from sc"))
def similarity_scores(spark, d):
    return _scored(spark, d).withColumns({c: F.round(c, 6) for c in ("score", "size_ratio", "file_count_ratio")}).orderBy(F.desc("score"), "folder_a", "folder_b")


@query(_with(TO_SCORES, "select track, count(*) as pairs, round(min(score), 6) as least, round(max(score), 6) as most from tr group by track"))
def tracks(spark, d):
    return _tracked(spark, d).groupBy("track").agg(F.count("*").alias("pairs"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))


_CANON = f"""case when {_BACK.format(_LAST.format("folder_a"))} and not {_BACK.format(_LAST.format("folder_b"))} then folder_b
  when {_BACK.format(_LAST.format("folder_b"))} and not {_BACK.format(_LAST.format("folder_a"))} then folder_a
  when len(string_split(folder_a, '/')) <= len(string_split(folder_b, '/')) then folder_a else folder_b end"""
_PROPOSAL = """select proposal_id, action, case when action = 'needs_review' then folder_a || '|' || folder_b when keep = folder_a then folder_b else folder_a end as sources,
  case when action <> 'needs_review' then keep end as target_path,
  case action when 'needs_review' then 'Folder pair needs review before any move because evidence is mixed: ' || reason || '.'
    when 'mark_backup' then 'Folder looks like a backup copy of ' || keep || ' based on ' || reason || '.'
    else 'Folder contents strongly overlap and should be merged into ' || keep || '.' end as reason, 'pending' as approval_state from x"""


def _flat(rows):
    return rows.withColumn("sources", F.array_join("source_paths", "|")).drop("source_paths")


@query(
    _with(
        TO_SCORES + f""",\nx as (select *, {_CANON} as keep, case track when 'backup' then 'mark_backup' else 'needs_review' end as action,
  printf('proposal-%04d', row_number() over (order by round(score, 9) desc, folder_a, folder_b)) as proposal_id from tr where track <> 'cluster')""",
        _PROPOSAL,
    )
)
def plan_proposals(spark, d):
    return _flat(proposals.outside_clusters(_tracked(spark, d).withColumn("score", F.round("score", 9))))


@query(
    _with(
        TO_SCORES + f""",\nx as (select *, {_CANON} as keep, case when score >= {MERGE} and name_bonus > 0 then 'mark_backup' when score >= {MERGE} then 'merge_folder' else 'needs_review' end as action,
  printf('proposal-%04d', row_number() over (order by round(score, 9) desc, folder_a, folder_b)) as proposal_id from sc)""",
        _PROPOSAL,
    )
)
def pair_proposals(spark, d):
    return _flat(proposals.pairwise(_scored(spark, d).withColumn("score", F.round("score", 9)), MERGE))


# ---------------------------------------------------------------- clusters


@query(_with(f"{TO_CLUSTERS},\n{SUPP}", "select cluster_id, count(*) as members, round(any_value(min_score), 6) as min_score, max(su.cluster_id) is not null as is_suppressed from cm join ms using (cluster_id) left join su using (cluster_id) group by cluster_id", True))
def clusters(spark, d):
    members, pairs = _clustered(spark, d)
    hidden = C.suppressed(members).withColumn("hidden", F.lit(True))
    per = members.groupBy("cluster_id").agg(F.count("*").alias("members")).join(C.least_scores(members, pairs), "cluster_id").join(hidden, "cluster_id", "left")
    return per.select("cluster_id", "members", F.round("min_score", 6).alias("min_score"), F.coalesce("hidden", F.lit(False)).alias("is_suppressed"))


@query(_with(TO_MASTERS, "select cluster_id, path, is_master, cast(file_count as bigint) as file_count, cast(total_bytes as bigint) as total_bytes from ma", True))
def cluster_members(spark, d):
    return _mastered(spark, d)[0]


@query(_with(TO_MASTERS, "select cluster_id, path as master from ma where is_master", True))
def cluster_master(spark, d):
    return _mastered(spark, d)[0].filter("is_master").select("cluster_id", F.col("path").alias("master"))


#: Hashes as the funnel leaves them: some files were never in doubt.
_SOME = UNIQ.format(m="ma", h="case when u.size % 3 <> 0 then u.h end")


def _some_hashed(files):
    return files.withColumn("full_hash", F.when(F.col("size") % 3 != 0, F.col("h")))


@query(_with(f"{TO_MASTERS},\n{_SOME}", "select cluster_id, copy, path, size from uq", True))
def unique_files(spark, d):
    files = _files(spark, d)
    return C.unique_files(_mastered(spark, d, files)[0], _some_hashed(files))


@query(
    _with(
        f"{TO_MASTERS},\n{SUPP},\n{_SOME}",
        """select cluster_id, path, is_master, cast(printf('%.4f', min_score) as double) as min_score, cluster_id in (select cluster_id from su) as is_suppressed, 'pending' as status,
  coalesce(n, 0) as unique_file_count from ma join ms using (cluster_id) left join (select cluster_id, copy as path, count(*) as n from uq group by all) using (cluster_id, path)""",
        True,
    )
)
def plan_members(spark, d):
    """The clusters as a plan holds them, a row per member."""
    files = _files(spark, d)
    mastered, members, pairs = _mastered(spark, d, files)
    tables = artifacts.plan_tables(mastered, C.least_scores(members, pairs), C.suppressed(members), C.unique_files(mastered, _some_hashed(files)))
    rows = tables["members"].join(tables["clusters"], "cluster_id")
    return rows.select("cluster_id", "path", "is_master", "min_score", "is_suppressed", "status", F.col("unique_file_count").cast("long").alias("unique_file_count"))


@query(_with(f"{TO_CLUSTERS},\n{SUPP}", "select cluster_id from su", True))
def suppressed_clusters(spark, d):
    return C.suppressed(_clustered(spark, d)[0])


@query(_with(f"{TO_CLUSTERS},\n{SUPP}", "select cm.cluster_id, path from cm where cluster_id not in (select cluster_id from su)", True))
def visible_clusters(spark, d):
    members = _clustered(spark, d)[0]
    return members.join(C.suppressed(members), "cluster_id", "left_anti")


_NEXT = """nx as materialized (select cluster_id, path, (row_number() over w - 1) = (max(case when is_master then rn end) over (partition by cluster_id) + 1) % count(*) over (partition by cluster_id) as is_master
  from (select *, row_number() over (partition by cluster_id order by path) - 1 as rn from ma) window w as (partition by cluster_id order by path))"""


@query(_with(f"{TO_MASTERS},\n{_NEXT},\n{UNIQ.format(m='nx', h='u.h')}", "select cluster_id, copy, count(*) as unique_files from uq group by all", True))
def cycled_master(spark, d):
    files = _files(spark, d)
    moved = C.next_master(_mastered(spark, d, files)[0])
    return C.unique_files(moved, _hashed(files)).groupBy("cluster_id", "copy").agg(F.count("*").alias("unique_files"))


@query(
    _with(
        TO_MASTERS,
        """select cluster_id, printf('· [%.2f] %-22s %8s', min_score, substr(list_extract(string_split(master, '/'), -1), 1, 22),
  case when b >= 1024 ** 3 then printf('%.1f GB', b / 1024.0 ** 3) when b >= 1024 ** 2 then printf('%.1f MB', b / 1024.0 ** 2) else printf('%.1f KB', b / 1024.0) end) as label
  from (select cluster_id, sum(total_bytes) as b, max(case when is_master then path end) as master from ma group by cluster_id) join ms using (cluster_id)""",
        True,
    )
)
def cluster_labels(spark, d):
    mastered, members, pairs = _mastered(spark, d)
    return C.labels(mastered, C.least_scores(members, pairs))


#: The same with pairs from every key, however many folders hold it.
_ALL_PAIRS = TO_MASTERS.replace(f"count(*) between 2 and {CAP}", "count(*) >= 2")


@query(_with(_ALL_PAIRS, "select case when cast(right(cluster_id, 4) as int) % 3 = 0 then 'approved' else 'pending' end as status, count(distinct cluster_id) as clusters from ma group by 1", True))
def review_counts(spark, d):
    """The clusters of all similar folders, without a cap on the folders that share a key, by review status."""
    files = _files(spark, d)
    keys, totals = _merged(files), materialize(tree.subtree_totals(files), "totals")
    pairs = materialize(similarity.close_pairs(keys, CLUSTER, similarity.pivots(keys, totals)), "pairs")
    scored = similarity.scores(pairs, keys, totals, CLUSTER)
    tracked = materialize(similarity.tracks(scored, MERGE, CLUSTER), "tracked")
    status = F.when(F.right("cluster_id", F.lit(4)).cast("int") % 3 == 0, "approved").otherwise("pending")
    return C.clusters(tracked.filter("track = 'cluster'")).select("cluster_id").distinct().groupBy(status.alias("status")).agg(F.count("*").alias("clusters"))


# ---------------------------------------------------------------- waste

_K = "string_split(path, '/')"
_CLUTTER = """w as (select case doc_id % 9 when 0 then 'C:/Windows/Temp' when 1 then 'C:/Users/u' || (doc_id % 4) || '/AppData/Local/Temp'
  when 2 then 'C:/proj/' || source || '/node_modules/pkg' || (doc_id % 4) when 3 then 'C:/proj/' || source || '/node_modules/pkg/__pycache__'
  when 4 then 'D:/Windows.old' when 5 then 'D:/a/Windows.old' when 6 then 'C:/Users/u' || (doc_id % 4) || '/AppData/Local/Google/Chrome/User Data/Default/Cache_Data'
  when 7 then 'C:/proj/' || source || '/.Venv/lib/' || lang else 'C:/proj/' || source || '/src' end as folder, n_chars as size from documents),
wu as (select size, array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') as path from (select *, unnest(range(2, len(string_split(folder, '/')) + 1)) as i from w)),
wt as (select path, cast(sum(size) as bigint) as size_bytes, count(*) as file_count from wu group by path),
""" + "wk as (select *, case " + " ".join(
    [f"when len({_K}) = 2 and upper({_K}[-1]) = '{n}' then '{c}|{x}|{str(r).lower()}'" for n, c, x, r in waste.TOP_NAMES]
    + [f"when regexp_matches(upper(path), '{p}') then '{c}|{x}|{str(r).lower()}'" for p, c, x, r in waste.PATTERNS]
    + [f"when upper({_K}[-1]) = '{n}' then '{c}|{x}|{str(r).lower()}'" for n, c, x, r in waste.NAMES]
) + """ end as kind from wt),
wm as (select * from wk where kind is not null),
wc as (select path, split_part(kind, '|', 1) as category, split_part(kind, '|', 2) as description, split_part(kind, '|', 3) = 'true' as requires_review, size_bytes, file_count
  from wm where not exists (select 1 from wm o where starts_with(wm.path, o.path || '/')))"""


@query(_with(_CLUTTER, "select * from wc"))
def waste_candidates(spark, d):
    return waste.candidates(cluttered_inventory(spark, d)).orderBy(F.desc("size_bytes"), "path")


@query(_with(_CLUTTER, "select path, category, size_bytes from wc where size_bytes >= 20000"))
def waste_above_floor(spark, d):
    return waste.candidates(cluttered_inventory(spark, d), 20000).select("path", "category", "size_bytes")


@query(
    _with(
        _CLUTTER,
        "select part, count(*) as folders, cast(sum(size_bytes) as bigint) as bytes from (select 'all' as part, size_bytes from wc union all select case when requires_review then 'review' else 'safe' end, size_bytes from wc) group by part",
    )
)
def waste_totals(spark, d):
    return waste.totals(waste.candidates(cluttered_inventory(spark, d)))


@query(_with(_CLUTTER, "select row_number() over (order by size_bytes desc, path) as rank, path, category, size_bytes from wc"))
def waste_ranked(spark, d):
    rows = with_running(waste.candidates(cluttered_inventory(spark, d)), [F.desc("size_bytes"), F.col("path")])
    return rows.select((F.col("place") + 1).alias("rank"), "path", "category", "size_bytes").orderBy("rank")


# ---------------------------------------------------------------- copying and checking

_COPY = """src as (select substr(path, 16) as relative, size, case when size % 4 <> 0 then h end as h from f where starts_with(path, 'D:/corpus/src3/')),
dst as (select substr(path, 17) as relative, case when size % 5 = 0 then size + 1 else size end as there, h as other from f where starts_with(path, 'F:/archive/src3/')),
cp as (select src.relative, size, case when there is null then 'copy' when size = there and h = other then 'same' else 'conflict' end as action from src left join dst using (relative))"""


def _copied(spark, d):
    files = inventory(spark, d)
    source = files.filter("path like 'D:/corpus/src3/%'").withColumn("full_hash", F.when(F.col("size") % 4 != 0, F.col("h")))
    target = files.filter("path like 'F:/archive/src3/%'").withColumn("full_hash", F.col("h")).withColumn("size", F.when(F.col("size") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return matching.copy_plan(source.union(target), "D:/corpus/src3", "F:/archive/src3")


@query(_with(f"{INV},\n{_COPY}", "select relative, size, action from cp"))
def copy_plan(spark, d):
    return _copied(spark, d)


@query(
    _with(
        f"{INV},\n{_COPY}",
        """select count(*) filter (action = 'copy') as files_copied, cast(coalesce(sum(size) filter (action = 'copy'), 0) as bigint) as bytes_copied,
  count(*) filter (action = 'conflict') as conflicts, count(*) filter (action = 'conflict') = 0 as verification_passed from cp""",
    )
)
def copy_totals(spark, d):
    return matching.copy_totals(_copied(spark, d))


@query(
    """with t as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents)
select doc_id, md5(unhex(substr(x, 1, 8192) || case when n > 4096 then substr(x, 2 * (n - 4096) + 1, 8192) else '' end || hex(encode(cast(n as varchar))))) as quick_hash,
  md5(unhex(x)) as full_hash, n // 1048576 as mb from t"""
)
def content_hashes(spark, d):
    """Quick and full hashes over a binary column."""
    rows = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    size = F.octet_length("content")
    return rows.select("doc_id", hashing.quick_md5(F.col("content"), size).alias("quick_hash"), F.md5("content").alias("full_hash"), sizes.whole_mb(size).alias("mb"))


# ---------------------------------------------------------------- snapshots

_LISTED = """ls as (select 'folder' as kind, path, case when starts_with(path, 'D:') then 'D:/corpus' when starts_with(path, 'E:') then 'E:/corpus' else 'F:/archive' end as root, mtime from fo)"""


@query(
    _with(
        f"{INV},\n{FOLD},\n{_LISTED}",
        """select root, cast(7 as bigint) as run_id, count(*) as total_folders, any_value(n) as total_files, count(*) filter (mtime >= 100) as indexed_folders, any_value(k) as indexed_files
  from ls join (select case when starts_with(path, 'D:') then 'D:/corpus' when starts_with(path, 'E:') then 'E:/corpus' else 'F:/archive' end as root,
    count(*) as n, count(*) filter (size >= 700) as k from f group by 1) using (root) group by root""",
    )
)
def root_stats(spark, d):
    """Counts per root of a listing in which some folders were not read."""
    files = inventory(spark, d)
    root = F.when(F.col("path").startswith("D:"), "D:/corpus").when(F.col("path").startswith("E:"), "E:/corpus").otherwise("F:/archive").alias("root")
    dirs = timed_folders(files)
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), "path", root)
    listing = row(dirs, "folder").union(row(dirs.filter("mtime >= 100"), "read")).union(row(files, "file"))
    return snapshot.root_stats(listing, tree.allowed(files, least=700), 7)


@query(_with(INV, "select path, 'moved' as folder, cast(size as bigint) as size, cast(null as varchar) as quick_hash, cast(0 as bigint) as run_id from f"))
def migrated(spark, d):
    """An older table with a column renamed and two added."""
    old = inventory(spark, d).select("path", F.lit("moved").alias("dir"), F.col("size").cast("long").alias("size"))
    return snapshot.with_columns(old, {"quick_hash": ("string", None), "run_id": ("long", "0")}, {"dir": "folder"})


_DAYS = "ev as (select user_id, cast(epoch(date_trunc('day', ts)) / 86400 as bigint) as run_id, max(value) as value, count(*) as n from events group by all)"


def _daily(spark, d):
    run = F.unix_date(F.to_date("ts")).cast("long").alias("run_id")
    return table(spark, d, "events").groupBy("user_id", run).agg(F.max("value").alias("value"), F.count("*").alias("n"))


@query(
    _with(
        _DAYS + ", lim as (select min(run_id) + 10 as cut from ev), old as (select * from ev, lim where run_id < cut), new as (select * from ev, lim where run_id >= cut)",
        "select coalesce(n.user_id, o.user_id) as user_id, coalesce(n.run_id, o.run_id) as run_id, coalesce(n.value, o.value) as value from "
        "(select user_id, max(run_id) as run_id, max_by(value, run_id) as value from old group by user_id) o full join (select user_id, max(run_id) as run_id, max_by(value, run_id) as value from new group by user_id) n on n.user_id = o.user_id",
    )
)
def snapshot_upsert(spark, d):
    rows = _daily(spark, d).drop("n")
    cut = rows.agg((F.min("run_id") + 10).alias("cut"))
    rows = rows.crossJoin(F.broadcast(cut))
    old = snapshot.latest_rows(rows.filter("run_id < cut").drop("cut"), "user_id")
    new = snapshot.latest_rows(rows.filter("run_id >= cut").drop("cut"), "user_id")
    return snapshot.upsert(old, new, "user_id").select("user_id", "run_id", "value")


@query(
    _with(
        INV,
        "select path, coalesce(case when size % 2 = 0 then 'n' || substr(h, 1, 4) end, substr(h, 1, 8)) as quick_hash, coalesce(case when size % 3 = 0 then 'n' || h end, case when size >= 2000 then h end) as full_hash from f",
    )
)
def hash_upsert(spark, d):
    files = inventory(spark, d)
    old = files.select("path", F.substring("h", 1, 8).alias("quick_hash"), F.when(F.col("size") >= 2000, F.col("h")).alias("full_hash"))
    new = files.select(
        "path", F.when(F.col("size") % 2 == 0, F.concat(F.lit("n"), F.substring("h", 1, 4))).alias("quick_hash"), F.when(F.col("size") % 3 == 0, F.concat(F.lit("n"), "h")).alias("full_hash")
    )
    return snapshot.upsert_hashes(old, new)


@query(_with(INV, "select path, size % 5 < 2 and (starts_with(path, 'E:/corpus/')) as is_missing from f"))
def tombstones(spark, d):
    rows = inventory(spark, d).select("path", F.when(F.col("size") % 5 < 2, 1).otherwise(2).alias("run_id"), F.lit(False).alias("is_missing"))
    return snapshot.tombstone(rows, "E:/corpus", 2).select("path", "is_missing")


@query(_with(f"{INV},\n{FOLD}", "select f.path, case when fo.mtime < 500 then 3 else 1 end as run_id from f join fo on fo.path = f.folder"))
def promoted(spark, d):
    files = inventory(spark, d).withColumn("run_id", F.lit(1))
    same = timed_folders(inventory(spark, d)).filter("mtime < 500").select(F.col("path").alias("folder"))
    return snapshot.promote(files, same, 3).select("path", "run_id")


@query(_with(INV, "select path, case when size % 7 <> 0 then size + 1 else size end as size, size % 7 = 0 as is_missing from f"))
def refreshed(spark, d):
    rows = inventory(spark, d).select("path", "size", F.lit(0.0).alias("mtime"), F.lit(False).alias("is_missing"))
    live = inventory(spark, d).filter("size % 7 <> 0").select("path", (F.col("size") + 1).alias("size"), F.lit(1.0).alias("mtime"))
    return snapshot.refresh(rows, live).select("path", "size", "is_missing")


@query(_with(INV, "select path, starts_with(path, 'F:/archive/') or (starts_with(path, 'E:/') and size % 7 = 0) as is_missing from f"))
def refreshed_subtrees(spark, d):
    rows = inventory(spark, d).select("path", "size", F.lit(0.0).alias("mtime"), F.lit(False).alias("is_missing"))
    live = inventory(spark, d).filter("size % 7 <> 0").select("path", "size", F.lit(1.0).alias("mtime"))
    roots = spark.sql("select * from values ('E:/corpus', true), ('F:/archive', false) as t(root, exists)")
    return snapshot.refresh_subtrees(rows, roots, live).select("path", "is_missing")


@query(_with(f"{INV},\n{FOLD}", "select path from fo where depth % 2 = 1 or mtime > 400"))
def delta_folders(spark, d):
    dirs = timed_folders(inventory(spark, d))
    state = dirs.filter("depth % 2 = 0").select("path", F.lit(400.0).alias("last_scan"))
    return snapshot.to_scan(dirs, state).select("path")


@query(
    _with(
        f"{INV},\n{FOLD}",
        "select a.root, folders, files, bytes from (select array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') as root, count(*) as folders from fo group by 1) a "
        "join (select array_to_string(list_slice(string_split(folder, '/'), 1, 2), '/') as root, count(*) as files, cast(sum(size) as bigint) as bytes from f group by 1) b using (root)",
    )
)
def scan_stats(spark, d):
    files = inventory(spark, d)
    return snapshot.scan_stats(files, tree.folders(files))


@query(
    """with s as (select user_id, max(ts) as last from events where event_type = 'signup' group by user_id), r as (select distinct user_id from events)
select 'root' || r.user_id as root, cast(floor((epoch(timestamp '2024-01-31') - floor(epoch(last))) / 86400) as bigint) as age_days
from r left join s using (user_id) where last is null or last < timestamp '2024-01-31' - interval 2 day"""
)
def stale_roots(spark, d):
    events = table(spark, d, "events")
    root = F.concat(F.lit("root"), "user_id").alias("root")
    stats = events.filter("event_type = 'signup'").groupBy(root).agg(F.max("ts").alias("last_scanned_at"))
    return snapshot.stale_roots(events.select(root).distinct(), stats, F.lit("2024-01-31 00:00:00").cast(events.schema["ts"].dataType), 2)


@query("select count(distinct cast(ts as date)) as runs, cast(coalesce(max(epoch(date_trunc('day', ts)) / 86400), 0) as bigint) as latest from events")
def run_counters(spark, d):
    return _daily(spark, d).agg(F.count_distinct("run_id").alias("runs"), F.coalesce(F.max("run_id"), F.lit(0)).alias("latest"))


# ---------------------------------------------------------------- the older analysis

_LEG = """lk as (select distinct anc as folder, filename || '|' || size as key from up), ln as (select folder, count(*) as n from lk group by folder),
dirt as (select path from fo where mtime % 3 <> 0),
lu as (select key from lk group by key having count(*) between 2 and 100), lh as (select lk.* from lk join lu using (key)),
lp as (select distinct a.folder as folder_a, b.folder as folder_b from lh a join lh b using (key) where a.folder < b.folder and not starts_with(b.folder, a.folder || '/')
  and (a.folder in (from dirt) or b.folder in (from dirt))),
lm as (select folder_a, folder_b, x.n as na, y.n as nb, count(*) as shared from lp join ln x on x.folder = folder_a join ln y on y.folder = folder_b
  join lk a on a.folder = folder_a join lk b on b.folder = folder_b and a.key = b.key group by all),
lr as (select folder_a, folder_b, shared / (na + nb - shared) as jaccard, shared from lm where shared / (na + nb - shared) >= 0.5 and least(na, nb) / greatest(na, nb) >= 0.5),
lf as (select folder_a, folder_b, jaccard, a.filename, a.size, a.path as path_a, b.path as path_b, a.h as h_a, b.h as h_b,
  substr(a.h, 1, 8) = substr(b.h, 1, 8) as quick_match, case when substr(a.h, 1, 8) = substr(b.h, 1, 8) then a.h = b.h end as full_match
  from lr join f a on a.folder = folder_a join f b on b.folder = folder_b and a.filename = b.filename and a.size = b.size)"""
TO_LEG = ",\n".join([INV, UP, FOLD, _LEG])


def _legacy(spark, d):
    files = materialize(inventory(spark, d), "files")
    dirs = timed_folders(files).select("path", F.lit(10.0).alias("analysed_at"), F.when(F.col("mtime") % 3 != 0, 11.0).otherwise(9.0).alias("scanned_at"))
    results = legacy.similar(materialize(legacy.signatures(files), "keys"), legacy.dirty(dirs), 0.5)
    return files, materialize(results, "results")


@query(_with(f"{INV},\n{FOLD}", "select path from fo where mtime % 3 <> 0"))
def legacy_dirty(spark, d):
    dirs = timed_folders(inventory(spark, d)).select("path", F.lit(10.0).alias("analysed_at"), F.when(F.col("mtime") % 3 != 0, 11.0).otherwise(9.0).alias("scanned_at"))
    return legacy.dirty(dirs).select("path")


@query(_with(TO_LEG, "select folder_a, folder_b, round(jaccard, 6) as jaccard, shared from lr"))
def legacy_jaccard(spark, d):
    return _legacy(spark, d)[1].withColumn("jaccard", F.round("jaccard", 6))


@query(_with(TO_LEG, "select path_a, path_b, filename, size, quick_match, full_match from lf"))
def legacy_file_pairs(spark, d):
    files, results = _legacy(spark, d)
    return legacy.confirm(legacy.file_pairs(results, files)).select("path_a", "path_b", "filename", "size", "quick_match", "full_match")


@query(
    _with(
        TO_LEG,
        """select s.root, folders, files, (select count(*) from lr where starts_with(folder_a, s.root)) as similar_pairs,
  (select count(*) from lf where full_match and starts_with(folder_a, s.root)) as duplicate_files,
  (select coalesce(sum(size), 0) / 1e9 from lf where full_match and starts_with(folder_a, s.root)) as duplicate_gb
  from (select array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') as root, count(*) as folders from fo group by 1) s
  join (select array_to_string(list_slice(string_split(folder, '/'), 1, 2), '/') as root, count(*) as files from f group by 1) using (root)""",
    )
)
def legacy_summary(spark, d):
    files, results = _legacy(spark, d)
    return legacy.summary(snapshot.scan_stats(files, tree.folders(files)), results, legacy.confirm(legacy.file_pairs(results, files)))


@query(_with(TO_LEG, "select path_a, path_b, filename, size, folder_a, folder_b, round(jaccard, 6) as jaccard from lf where full_match"))
def legacy_duplicates(spark, d):
    files, results = _legacy(spark, d)
    rows = legacy.confirm(legacy.file_pairs(results, files)).filter("full_match")
    return rows.select("path_a", "path_b", "filename", "size", "folder_a", "folder_b", F.round("jaccard", 6).alias("jaccard")).orderBy(F.desc("size"))


@query(
    _with(
        TO_LEG,
        """select folder_a, folder_b, round(jaccard, 6) as jaccard, shared, a.file_count as files_a, b.file_count as files_b, cast(a.total_bytes as bigint) as bytes_a, cast(b.total_bytes as bigint) as bytes_b,
  coalesce(n, 0) as confirmed_dups, s as dup_bytes from lr join fo a on a.path = folder_a join fo b on b.path = folder_b
  left join (select folder_a, folder_b, count(*) as n, cast(sum(size) as bigint) as s from lf where full_match group by all) using (folder_a, folder_b)""",
    )
)
def legacy_similar_folders(spark, d):
    files, results = _legacy(spark, d)
    rows = legacy.similar_folders(results, tree.folders(files), legacy.confirm(legacy.file_pairs(results, files)))
    return rows.withColumn("jaccard", F.round("jaccard", 6)).orderBy(F.col("dup_bytes").desc_nulls_last())


@query(_with(f"{INV},\n{FOLD}", "select path, cast(case when mtime % 3 <> 0 then 12 else 10 end as double) as analysed_at from fo"))
def legacy_marked(spark, d):
    dirs = timed_folders(inventory(spark, d)).select("path", F.lit(10.0).alias("analysed_at"), F.when(F.col("mtime") % 3 != 0, 11.0).otherwise(9.0).alias("scanned_at"))
    return legacy.mark_analysed(dirs, F.lit(12.0)).select("path", "analysed_at")


@query(
    _with(
        TO_LEG,
        """select folder_a, folder_b, cast(0.5 as double) as jaccard from (select parent as folder_a, path as folder_b from fo where parent is not null)
  where folder_a not in (from dirt) and folder_b not in (from dirt) union all select folder_a, folder_b, round(jaccard, 6) from lr""",
    )
)
def legacy_replaced(spark, d):
    """Results of folders analysed again take the place of the old ones."""
    files, new = _legacy(spark, d)
    dirs = timed_folders(files)
    old = dirs.filter("parent is not null").select(F.col("parent").alias("folder_a"), F.col("path").alias("folder_b"), F.lit(0.5).alias("jaccard"))
    rows = legacy.replace_results(old, new.select("folder_a", "folder_b", "jaccard"), dirs.filter("mtime % 3 <> 0").select("path"))
    return rows.withColumn("jaccard", F.round("jaccard", 6))


@query(_with(f"{INV},\n{FOLD}", "select path from fo where depth % 2 = 0"))
def legacy_unchanged(spark, d):
    dirs = timed_folders(inventory(spark, d))
    state = dirs.select("path", F.when(F.col("depth") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"))
    return legacy.unchanged(dirs, state).select("path")


@query(_with(INV, "select path from f where size >= 500 and size <= 3000 and regexp_extract(filename, '[^.]([.][^.]+)$', 1) not in ('.de', '.EN')"))
def legacy_allowed(spark, d):
    return legacy.allowed(inventory(spark, d), (".de", ".EN"), 500, 3000).select("path")


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
