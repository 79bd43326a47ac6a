"""Queries of the operators that are DataFrame functions only, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import licenses, mixing, reshard

#: Target weights of the query: src0 gets three parts, src1 two, others one.
WEIGHTS = {"src0": 3, "src1": 2}
BLOCK_ROWS = 4
#: Shards of the documents.
SHARDS = 8


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mix of sources to target weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS, block_rows=BLOCK_ROWS)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that whole documents are, and notices on their lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licenses.scan(docs, licenses.known_licenses(spark), shipped=licenses.shipped_licenses(spark))


def op11_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from the uneven shards that their sources' checksums give to SHARDS even ones, by the fewest bytes moved."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    old = reshard.lay_out(docs, F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % SHARDS)
    new, _ = reshard.reshard(old, reshard.equal_capacities(old.sizes(), SHARDS))
    return reshard.slots(new).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP7_SQL = f"""
WITH RECURSIVE src AS (
  SELECT source, count(*) AS n, CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 1 END::BIGINT AS a,
         row_number() OVER (ORDER BY source NULLS FIRST) AS i
  FROM documents GROUP BY source),
par AS (SELECT list(a ORDER BY i) AS a, sum(a)::BIGINT AS q, count(*) AS k FROM src),
sched AS (
  SELECT -1::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM par
  UNION ALL
  SELECT t + 1, list_transform(done, lambda n, i: CASE WHEN i = p THEN n + 1 ELSE n END), p
  FROM (SELECT t, done, q, list_min(list_filter(list_transform(a, lambda x, i:
          CASE WHEN done[i] < x AND (done[i] * q) // x <= t + 1 THEN (((done[i] + 1) * q + x - 1) // x) * 100000 + i END), lambda e: e IS NOT NULL)) % 100000 AS p
        FROM sched, par WHERE t + 1 < q)),
slots AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM sched WHERE t >= 0),
docs AS (
  SELECT d.doc_id, d.source, s.i, s.a, (row_number() OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1) // {BLOCK_ROWS} AS block
  FROM documents d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
lacks AS (SELECT min(((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} // src.a) * q + t) AS lim FROM src JOIN slots USING (i), par WHERE slots.k = ((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) % src.a)
SELECT doc_id, source, block, (block * q) // d.a AS release, ((block + 1) * q + d.a - 1) // d.a AS due,
       (block // d.a) * q + t AS slot, (block // d.a) * q + t < lim AS in_mix
FROM docs d JOIN slots ON slots.i = d.i AND slots.k = block % d.a, par, lacks
"""


def _canonical_sql(x: str, dropped: str = licenses.COPYRIGHT_LINE) -> str:
    form = f"lower(regexp_replace({x}, '{dropped}', '', 'g'))"
    for old, new in licenses.SPELLINGS:
        form = f"replace({form}, '{old}', '{new}')"
    return f"trim(regexp_replace({form}, '{licenses.PUNCTUATION}', ' ', 'g'))"


def _digest_sql(x: str) -> str:
    form = _canonical_sql(x)
    return f"CASE WHEN {form} <> '' THEN sha256({form}) END"


def _shipped_sql(x: str) -> str:
    body = f"CASE WHEN regexp_matches({x}, '{licenses.NO_TITLE}') THEN {x} ELSE regexp_replace({x}, '{licenses.TITLE}', '') END"
    form = _canonical_sql(f"regexp_replace({body}, '{licenses.LIST_MARK}', '', 'g')", licenses.STATEMENT)
    for names, one in licenses.HOLDERS:
        form = f"regexp_replace({form}, '{names}', '{one}', 'g')"
    return f"CASE WHEN regexp_matches({x}, '{licenses.SPEAKS}') THEN {form} END"


OP10_SQL = f"""
WITH files AS (SELECT parse_filename(filename, true) AS license_id, content AS t FROM read_text('{licenses.TEXTS}/*.txt')),
parts AS (
  SELECT license_id, t FROM files
  UNION ALL SELECT license_id, regexp_extract(t, '(?s).*END OF TERMS AND CONDITIONS') FROM files WHERE t LIKE '%END OF TERMS AND CONDITIONS%'
  UNION ALL SELECT license_id, regexp_extract(t, '(?s)(.*)END OF TERMS AND CONDITIONS', 1) FROM files WHERE t LIKE '%END OF TERMS AND CONDITIONS%'),
shipped AS (SELECT sha256(form) AS shipped, min(license_id) AS license_id FROM (SELECT license_id, {_shipped_sql("t")} AS form FROM parts) WHERE form <> '' GROUP BY 1),
known AS (
  SELECT digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_digest_sql("body")} AS digest FROM (VALUES {", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in licenses.KNOWN)}) v(license_id, body))
  WHERE digest IS NOT NULL GROUP BY digest),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices
  FROM (SELECT doc_id, {_digest_sql("line")} AS digest FROM lines WHERE regexp_matches(lower(line), '{licenses.NOTICE}')) JOIN known USING (digest)
  GROUP BY doc_id),
whole AS (SELECT doc_id, {_digest_sql("text")} AS digest, CASE WHEN form <> '' THEN sha256(form) END AS shipped FROM (SELECT doc_id, text, {_shipped_sql("text")} AS form FROM documents))
SELECT w.doc_id, w.digest, coalesce(k.license_id, s.license_id) AS license_id, coalesce(f.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN shipped s ON w.shipped = s.shipped LEFT JOIN found f ON w.doc_id IS NOT DISTINCT FROM f.doc_id
"""

def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return table


def crc32_sql(source: str, keys: str, text: str) -> str:
    """SELECT of ``keys`` and the ``crc`` of a text's UTF-8 bytes from a relation; a null counts as empty.

    Texts become bytes in pieces, as DuckDB cuts short strings faster.
    """
    return f"""
SELECT {keys}, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[xor(c, x) % 256 + 1])), 4294967295) AS crc
FROM (SELECT {keys}, flatten(list(bytes ORDER BY piece)) AS bytes
  FROM (SELECT {keys}, row_no, piece, list_transform(range(0, length(h)::BIGINT, 2), lambda i: ('0x' || h[i+1:i+2])::BIGINT) AS bytes
    FROM (SELECT {keys}, row_no, piece, h[piece * 128 + 1:piece * 128 + 128] AS h
      FROM (SELECT {keys}, row_number() OVER () AS row_no, hex(encode(coalesce({text}, ''))) AS h FROM {source}), unnest(range(0, greatest(length(h) + 127, 128) // 128)) u(piece)))
  GROUP BY {keys}, row_no)"""


#: Shards as intervals on a line of bytes: what is beyond the capacities meets the room that is left.
OP11_SQL = f"""
WITH src AS ({crc32_sql("(SELECT DISTINCT coalesce(source, '') AS source FROM documents)", "source", "source")}),
docs AS ({crc32_sql("documents", "doc_id, source, text", "text")}),
d AS (SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m, strlen(coalesce(text, '')) + 1 AS size, docs.crc, CAST(src.crc % {SHARDS} AS INT) AS old FROM docs JOIN src ON coalesce(docs.source, '') = src.source),
s AS (SELECT shard, coalesce(bytes, 0) AS bytes, t * (shard + 1) // {SHARDS} - t * shard // {SHARDS} AS capacity
  FROM range({SHARDS}) r(shard) LEFT JOIN (SELECT old, sum(size)::BIGINT AS bytes FROM d GROUP BY old) ON old = shard, (SELECT sum(size)::BIGINT AS t FROM d)),
k AS (SELECT *, least(bytes, capacity) AS keep, sum(bytes - least(bytes, capacity)) OVER (ORDER BY shard)::BIGINT AS s1, sum(capacity - least(bytes, capacity)) OVER (ORDER BY shard)::BIGINT AS r1 FROM s),
spans AS (
  SELECT shard AS old, shard AS new, 0 AS a, keep AS b FROM k WHERE keep > 0
  UNION ALL
  SELECT o.shard, n.shard, o.keep + greatest(o.s1 - (o.bytes - o.keep), n.r1 - (n.capacity - n.keep)) - (o.s1 - (o.bytes - o.keep)), o.keep + least(o.s1, n.r1) - (o.s1 - (o.bytes - o.keep))
  FROM k o JOIN k n ON greatest(o.s1 - (o.bytes - o.keep), n.r1 - (n.capacity - n.keep)) < least(o.s1, n.r1)),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY old ORDER BY m, coalesce(CAST(doc_id AS VARCHAR), ''), size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size // 2 AS mid FROM d),
placed AS (SELECT doc_id, m, size, crc, new FROM p JOIN spans ON p.old = spans.old AND mid >= a AND mid < b)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, new::INT AS shard, row_number() OVER (PARTITION BY new ORDER BY m, coalesce(CAST(doc_id AS VARCHAR), ''), size, crc) - 1 AS slot, NULL::INT AS grown_shard FROM placed
"""

QUERIES = {"op7_mixing": op7_mixing, "op10_license_scan": op10_license_scan, "op11_reshard": op11_reshard}
ORACLES = {"op7_mixing": OP7_SQL, "op10_license_scan": OP10_SQL, "op11_reshard": OP11_SQL}
