"""Manifest validation, leakage audits and set operations on a manifest with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.hashing import unit_hash
from assay.functions.provenance import FAMILIES
from assay.functions.arrays import let, mean
from assay.operators import joins, quality, sampling
from assay.plans.base import query
from assay.plans.proxies import assets, big_endian, grids, jpeg_file, manifest, png_file, table, u_sql, with_ctes
from assay.sources import scans, sinks

U = unit_hash


def dirty(spark, sf):
    """The manifest with empty fields, copied paths, bad enums, hashes and sizes planted by hash."""
    m = manifest(spark, sf)
    k = F.col("doc_id")
    folder = F.regexp_replace("path", r"/[^/]*$", "/copy.jpg")
    split = F.when(U("sp", k) < 0.7, "train").when(U("sp", k) < 0.9, "dev").otherwise("sealed")
    return m.select(
        "doc_id",
        F.when(U("dup", k) < 0.1, folder).otherwise(F.col("path")).alias("path"),
        F.when(U("lab", k) < 0.03, "maybe").otherwise(F.col("label")).alias("label"),
        F.when(U("fam", k) < 0.05, "").when(U("fam", k) < 0.08, "mystery").otherwise(F.col("family")).alias("family"),
        "source",
        F.when(U("lic", k) >= 0.04, F.col("license")).alias("license"),
        F.when(U("ok", k) < 0.02, "test").otherwise(split).alias("split"),
        F.when(U("sha", k) < 0.03, F.upper("sha256")).when(U("sha", k) >= 0.06, F.col("sha256")).alias("sha256"),
        F.when(U("siz", k) < 0.02, 0).otherwise(F.col("size_bytes")).cast("long").alias("size_bytes"),
        "lang",
        "doc_source",
    )


def _u(salt: str) -> str:
    return u_sql(f"'{salt}'", "doc_id")


DIRTY = f"""dirty AS (SELECT doc_id,
  CASE WHEN {_u('dup')} < 0.1 THEN regexp_replace(path, '/[^/]*$', '/copy.jpg') ELSE path END AS path,
  CASE WHEN {_u('lab')} < 0.03 THEN 'maybe' ELSE label END AS label,
  CASE WHEN {_u('fam')} < 0.05 THEN '' WHEN {_u('fam')} < 0.08 THEN 'mystery' ELSE family END AS family, source,
  CASE WHEN {_u('lic')} >= 0.04 THEN license END AS license,
  CASE WHEN {_u('ok')} < 0.02 THEN 'test' WHEN {_u('sp')} < 0.7 THEN 'train' WHEN {_u('sp')} < 0.9 THEN 'dev' ELSE 'sealed' END AS split,
  CASE WHEN {_u('sha')} < 0.03 THEN upper(sha256) WHEN {_u('sha')} >= 0.06 THEN sha256 END AS sha256,
  CASE WHEN {_u('siz')} < 0.02 THEN 0 ELSE size_bytes END AS size_bytes, lang, doc_source
  FROM manifest)"""


def dirty_sql(body: str) -> str:
    return with_ctes("manifest", body="").rstrip() + ",\n" + DIRTY + "\n" + body


_EMPTY = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field FROM dirty WHERE coalesce({f}, '') = ''" for f in quality.REQUIRED
)


@query("dq_missing_provenance", dirty_sql(_EMPTY))
def q_missing(spark, sf):
    return quality.missing_provenance(dirty(spark, sf), "doc_id")


_DUP_PATH = "SELECT path, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS k FROM dirty) WHERE k > 1"


@query("dq_duplicate_path", dirty_sql(_DUP_PATH))
def q_dup_path(spark, sf):
    return quality.duplicate_path(dirty(spark, sf), "doc_id")


@query(
    "dq_missing_file",
    dirty_sql("SELECT path FROM dirty d WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.path = d.path)"),
)
def q_missing_file(spark, sf):
    return quality.missing_file(dirty(spark, sf), assets(spark, sf))


_FILES = f"""files AS (
  SELECT doc_id, path, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpeg' END AS container,
    coalesce(strlen(content), 0) + CASE WHEN doc_id % 2 = 0 THEN 69 ELSE 37 END + CASE WHEN doc_id % 3 > 0 THEN 0 WHEN doc_id % 2 = 0 THEN 20 ELSE 18 END AS whole,
    CASE WHEN {_u('bad')} < 0.02 THEN 'cut' WHEN {_u('bad')} < 0.04 THEN CASE WHEN doc_id % 2 = 0 THEN 'crc' ELSE 'broken' END
         WHEN {_u('bad')} < 0.05 THEN 'unknown' ELSE 'ok' END AS state
  FROM assets)"""


def files_sql(body: str) -> str:
    return with_ctes("assets", body="").rstrip() + f", {_FILES} {body}"


def files(spark, sf):
    """(doc_id, path, content): each document as a PNG or JPEG file, one in twenty cut, flipped or with another signature."""
    text = F.encode(F.coalesce("content", F.lit("")), "UTF-8")
    k, png = F.col("doc_id"), F.col("doc_id") % 2 == 0
    whole = F.when(png, png_file(text, k % 3 == 0)).otherwise(jpeg_file(text, k % 3 == 0))

    def damaged(c):
        n = F.octet_length(c)
        # a checksum of PNG image data, the first marker after the head of a JPEG
        at = F.when(png, n - 12).otherwise(F.lit(3))
        byte = F.conv(F.hex(F.substring(c, at, F.lit(1))), 16, 10).cast("long")
        flipped = F.concat(F.substring(c, F.lit(1), at - 1), big_endian(byte.bitwiseXOR(F.lit(1)), 1), F.substring(c, at + 1, n))
        return (
            F.when(U("bad", k) < 0.02, F.substring(c, F.lit(1), F.floor(n / 2).cast("int")))
            .when(U("bad", k) < 0.04, flipped)
            .when(U("bad", k) < 0.05, F.concat(F.lit(b"XX"), F.substring(c, F.lit(3), n)))
            .otherwise(c)
        )

    return assets(spark, sf).select("doc_id", "path", let(whole, damaged).alias("content"))


@query(
    "dq_tiny_or_corrupt",
    files_sql("""SELECT path, CASE WHEN state <> 'ok' THEN 'corrupt' ELSE 'tiny' END AS kind FROM files
WHERE state <> 'ok' OR whole < 1024"""),
)
def q_tiny(spark, sf):
    return quality.damaged_or_tiny(files(spark, sf))


@query(
    "container_audit",
    files_sql("""SELECT doc_id, CASE WHEN state = 'unknown' THEN 'none' ELSE container END AS container, state,
  CASE WHEN state = 'cut' THEN whole // 2 ELSE whole END AS length FROM files"""),
)
def q_containers(spark, sf):
    return quality.container_audit(files(spark, sf), "doc_id").drop("exif")


@query(
    "dq_duplicate_hash",
    dirty_sql("SELECT sha256, count(*) AS n FROM dirty WHERE sha256 <> '' GROUP BY sha256 HAVING count(*) > 1"),
)
def q_dup_hash(spark, sf):
    return quality.duplicate_hash(dirty(spark, sf))


@query(
    "near_dup_signature",
    with_ctes(
        "px",
        body="""SELECT signature, count(*) AS n, min(id) AS first_key FROM (
  SELECT id, md5(string_agg(CASE WHEN m > g THEN '1' ELSE '0' END, '' ORDER BY r)) AS signature
  FROM (SELECT id, r, m, avg(m) OVER (PARTITION BY id) AS g FROM (SELECT id, r, avg(v) AS m FROM px GROUP BY id, r))
  GROUP BY id) GROUP BY signature HAVING count(*) > 1""",
    ),
)
def q_near_dup(spark, sf):
    """Eight row means per grid: whole 8x8 signatures never collide on the test tables."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: mean(F.slice("grid", i * 8 + 1, 8)))
    coarse = grids(spark, sf).select("id", rows.alias("rows"))
    return quality.near_dup_groups(
        coarse.select("id", quality.near_dup_signature(F.col("rows")).alias("signature")), "id", "signature"
    )


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RULES = {f"required:{f}": f"{f} IS NULL" for f in (*quality.REQUIRED, "split", "sha256")}
_RULES |= {
    "enum:label": f"label NOT IN {_in(quality.LABELS)}",
    "enum:family": f"family NOT IN {_in(FAMILIES)}",
    "enum:split": f"split NOT IN {_in(quality.SPLITS)}",
    "pattern:sha256": "NOT regexp_full_match(sha256, '[0-9a-f]{64}')",
    "minimum:size_bytes": "size_bytes < 1",
}
_SCHEMA_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM dirty WHERE {c}" for n, c in _RULES.items())


@query("dq_schema_constraints", dirty_sql(_SCHEMA_SQL))
def q_schema(spark, sf):
    return quality.schema_violations(dirty(spark, sf), "doc_id")


@query(
    "dq_verdict",
    dirty_sql(
        f"""SELECT CASE WHEN p > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, p AS n_problems, w AS n_warnings FROM (SELECT
  (SELECT count(*) FROM ({_EMPTY})) + (SELECT count(*) FROM ({_DUP_PATH})) +
  (SELECT count(*) FROM (SELECT sha256 FROM dirty WHERE sha256 <> '' GROUP BY 1 HAVING count(*) > 1)) +
  (SELECT count(*) FROM dirty WHERE split <> 'sealed' AND path LIKE '%holdout_oos%') AS p,
  (SELECT count(*) FROM dirty WHERE size_bytes < 1024) AS w)"""
    ),
)
def q_verdict(spark, sf):
    d = dirty(spark, sf)
    open_rows = d.where("split <> 'sealed'")
    problems = {
        "missing": quality.missing_provenance(d, "doc_id"),
        "paths": quality.duplicate_path(d, "doc_id"),
        "hashes": quality.duplicate_hash(d),
        "sealed": joins.sealed_tag_hits(open_rows.select("doc_id", "path")),
    }
    return quality.verdict(problems, {"tiny": d.where(F.col("size_bytes") < quality.MIN_BYTES)})


_SPANS = """SELECT '{k}' AS kind, {k}::VARCHAR AS key, min(split) AS first_split, max(split) AS last_split, count(*) AS n
FROM dirty WHERE coalesce({k}::VARCHAR, '') <> '' GROUP BY {k} HAVING count(DISTINCT split) > 1"""


@query("split_disjoint", dirty_sql(" UNION ALL ".join(_SPANS.format(k=k) for k in ("path", "sha256"))))
def q_disjoint(spark, sf):
    return quality.split_disjoint(dirty(spark, sf), ["path", "sha256"])


LEAK_KEYS = ("family", "doc_source", "sha256", "lang", "path")


@query(
    "group_leak_audit",
    dirty_sql(
        " UNION ALL ".join(
            f"SELECT kind AS group_key, count(*) AS leaking_groups, coalesce(sum(n), 0)::BIGINT AS rows_in_leaks FROM ({_SPANS.format(k=k)}) GROUP BY kind"
            for k in LEAK_KEYS
        )
    ),
)
def q_leaks(spark, sf):
    return quality.group_leak_audit(dirty(spark, sf), list(LEAK_KEYS))


@query(
    "split_reconcile",
    with_ctes(
        "manifest",
        body="""SELECT coalesce(d.split, a.split) AS split, coalesce(d.k, 0) AS declared_rows, coalesce(a.k, 0) AS actual_rows,
  coalesce(d.k, 0) = coalesce(a.k, 0) AS matches
FROM (SELECT split, count(*) AS k FROM parts GROUP BY split) d
FULL JOIN (SELECT split, count(*) AS k FROM (SELECT split, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS c FROM parts)
           WHERE c = 1 GROUP BY split) a ON d.split = a.split""",
    ).replace(
        "\nSELECT coalesce(d.split",
        ",\nparts AS (SELECT *, CASE WHEN sealed THEN 'sealed' WHEN quality = 1 THEN 'dev' ELSE 'train' END AS split FROM manifest)\n"
        "SELECT coalesce(d.split",
    ),
)
def q_reconcile(spark, sf):
    """A registry written before the dedup against the rows left after it."""
    split = F.when(F.col("sealed"), "sealed").when(F.col("quality") == 1, "dev").otherwise("train")
    parts = manifest(spark, sf).withColumn("split", split)
    declared = scans.registry_splits(sinks.registry_row(parts, "assay"))
    actual = sampling.dedup_exact(parts, "sha256", [F.col("path")], ["path", "split"])
    return quality.split_reconcile(declared, actual)


@query(
    "assemble_sources",
    """SELECT source, label, count(*) AS n, count(url) AS n_url, count(lang) AS n_lang FROM (
  SELECT 'web' AS source, 'real' AS label, url, NULL AS lang FROM pages UNION ALL
  SELECT 'docs', 'ai', NULL, lang FROM documents UNION ALL
  SELECT 'chat', 'ai', NULL, NULL FROM conversations) GROUP BY ALL""",
)
def q_assemble(spark, sf):
    parts = [
        ("web", "real", table(spark, sf, "pages").select(F.col("url").alias("path"), "url")),
        ("docs", "ai", table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang")),
        ("gone", "real", None),
        ("chat", "ai", table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"))),
    ]
    return quality.assemble_sources(parts).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count("url").alias("n_url"), F.count("lang").alias("n_lang")
    )
