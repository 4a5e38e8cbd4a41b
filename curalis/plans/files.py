"""Sources bound to files that the queries write from the driver's tables, with SQL twins over the tables themselves."""

from __future__ import annotations

import io
import os
import sys
import zipfile
import zlib

from pyspark import cloudpickle
from pyspark.sql import functions as F

from curalis.functions.nested import canonical_json
from curalis.operators import scans
from curalis.plans.bindings import query
from curalis.plans.nested import _esc
from curalis.sources import archives, canonical, scratch, strict, trees


def _write(df, root: str, change) -> None:
    """change(row) gives (path below root, bytes | ('link', target) | 'fifo'); each task writes its rows' files. Written again, a file is the same."""
    def run(batches):
        import pandas as pd

        for b in batches:
            for row in b.itertuples(index=False):
                path, what = change(row)
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if os.path.lexists(full):
                    os.remove(full)
                if isinstance(what, bytes):
                    with open(full, "wb") as f:
                        f.write(what)
                elif what == "fifo":
                    os.mkfifo(full)
                else:
                    os.symlink(what[1], full)
        yield pd.DataFrame({"n": [0]})

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    df.mapInPandas(run, "n int").count()


def _tree(t):
    d = t("documents").select("doc_id", "text")
    root = scratch.folder(d.sparkSession, "tree")

    def entry(row):
        k = row.doc_id
        path = f"x{k % 20}/{'wide' if k % 20 == 7 else f'y{k}' if k % 20 == 9 else f'y{k // 20 % 20}'}/doc{k}"
        if k % 13 == 0:
            return path, ("link", ("../y0" if k % 2 else "../../../up") if k % 3 else f"gone{k}")
        return path, "fifo" if k % 29 == 0 else (row.text or "").encode()

    _write(d, root, entry)
    return d.sparkSession, root


_TREE = """WITH f AS (SELECT *, 'x' || doc_id % 20 AS a, CASE doc_id % 20 WHEN 7 THEN 'wide' WHEN 9 THEN 'y' || doc_id ELSE 'y' || (doc_id // 20) % 20 END AS b, 'doc' || doc_id AS c, CASE WHEN doc_id % 13 = 0 THEN 'SYMLINK' WHEN doc_id % 29 = 0 THEN 'SPECIAL_FILE' ELSE 'REGULAR_FILE' END AS o FROM documents),
e AS (SELECT a || '/' || b || '/' || c AS path, a || '/' || b AS parent, o AS object_type, CASE WHEN o = 'REGULAR_FILE' THEN strlen(coalesce(text, '')) END AS size_bytes, CASE WHEN o = 'SYMLINK' THEN CASE WHEN doc_id % 3 = 0 THEN 'gone' || doc_id WHEN doc_id % 2 = 1 THEN '../y0' ELSE '../../../up' END END AS target, CASE WHEN o = 'REGULAR_FILE' THEN text END AS text FROM f
  UNION SELECT a || '/' || b, a, 'DIRECTORY', NULL, NULL, NULL FROM f UNION SELECT a, '.', 'DIRECTORY', NULL, NULL, NULL FROM f UNION SELECT '.', NULL, 'DIRECTORY', NULL, NULL, NULL),
w AS (SELECT parent AS wide FROM e WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) > 21),
l AS (SELECT *, path IN (SELECT wide FROM w) AS wide FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE wide = '.' AND path <> '.' OR starts_with(path, wide || '/'))) """


@query("s001_tree_scan", _TREE + """SELECT path, object_type, size_bytes, target AS symlink_target_text, CASE WHEN wide THEN 'DIRECTORY_ENTRY_LIMIT' WHEN object_type = 'SPECIAL_FILE' THEN 'SPECIAL_FILE_NOT_READ' ELSE '' END AS warnings,
 CASE WHEN size_bytes > 3000 THEN 'CONTENT_HASH_SKIPPED_SIZE_LIMIT' END AS limitation, CASE WHEN size_bytes <= 3000 THEN 'sha256-file-v1:' || sha256(coalesce(text, '')) END AS content_id FROM l""")
def _(t):
    spark, root = _tree(t)
    s = trees.scan(spark, root, max_file=3000, max_total=1 << 50, max_entries=21, slices=8)
    return s.select("path", "object_type", F.when(F.col("object_type") == "REGULAR_FILE", F.col("size_bytes")).alias("size_bytes"), "symlink_target_text", F.array_join("warnings", ",").alias("warnings"), "limitation", "content_id")


_PART = "unhex(printf('%016x', strlen({0}))) || encode({0})"


@query("s021_inventory_records", _TREE + f"""SELECT 'art_r_' || lpad(CAST(row_number() OVER (ORDER BY path) AS VARCHAR), 8, '0') AS artifact_id, path AS repository_relative_path, object_type, size_bytes, target AS symlink_target_text, CASE WHEN path = '.' THEN '/tree' ELSE '/tree/' || path END AS realpath,
 CASE WHEN size_bytes <= 3000 THEN 'sha256-file-v1' END AS fingerprint_scheme, CASE WHEN size_bytes <= 3000 THEN sha256(coalesce(text, '')) END AS fingerprint, CASE WHEN size_bytes <= 3000 THEN 'sha256-file-v1:' || sha256(coalesce(text, '')) END AS content_id, CASE WHEN size_bytes <= 3000 THEN 'ELIGIBLE' ELSE 'NOT_APPLICABLE' END AS profile_eligibility,
 CASE WHEN wide THEN 'DIRECTORY_ENTRY_LIMIT' WHEN object_type = 'SPECIAL_FILE' THEN 'SPECIAL_FILE_NOT_READ' WHEN size_bytes > 3000 THEN 'CONTENT_HASH_SKIPPED_SIZE_LIMIT' ELSE '' END AS warnings, sha256({_PART.format("'/tree'")} || {_PART.format('object_type')} || {_PART.format('path')}) AS location_id,
 object_type IN ('DIRECTORY', 'SYMLINK') AS executable, false AS ignored_included, 'UNRESOLVED' AS lineage_status FROM l""")
def _(t):
    spark, root = _tree(t)
    r = trees.inventory_records(trees.scan(spark, root, max_file=3000, max_total=1 << 50, max_entries=21, slices=8), "/tree", "r", "now", "v1")
    return r.withColumn("warnings", F.array_join("warnings", ",")).select("artifact_id", "repository_relative_path", "object_type", "size_bytes", "symlink_target_text", "realpath", "fingerprint_scheme", "fingerprint", "content_id", "profile_eligibility", "warnings", "location_id", "executable", "git_state.ignored_included", "lineage_status")


@query("s004_scanned_links", _TREE + """, x AS (SELECT path, target, parent FROM l WHERE object_type = 'SYMLINK')
SELECT path, 'sha256-symlink-target-v1:' || sha256(target) AS fingerprint, CASE WHEN target = '../../../up' THEN 'SYMLINK_TARGET_OUTSIDE_ROOT' WHEN target LIKE 'gone%' THEN 'SYMLINK_TARGET_MISSING' WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.path = split_part(x.path, '/', 1) || '/y0') THEN 'SYMLINK_TARGET_MISSING' END AS warning FROM x""")
def _(t):
    spark, root = _tree(t)
    found = trees.read_tree(spark, root, max_entries=21, slices=8)
    links = found.filter("object_type = 'SYMLINK'").select("path", F.col("symlink_target_text").alias("target"))
    return scans.link_warnings(links, found.select("path", "object_type"))


_BODIES = ["x" * i for i in range(6)]


def archive_bytes(k: int) -> bytes:
    """An archive by the number of its part: whole, cut off, of another format, encrypted, packed too tightly, with a lying end record, an unsafe or repeated name, or behind other bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(k % 6):
            z.writestr(zipfile.ZipInfo(f"d/f{i}"), _BODIES[i])
        if k % 7 == 0:
            z.writestr(zipfile.ZipInfo("../up"), "")
        if k % 11 == 0:
            z.writestr(zipfile.ZipInfo("Same"), "")
            z.writestr(zipfile.ZipInfo("sAME"), "")
        if k % 13 == 0:
            z.writestr(zipfile.ZipInfo("zeros"), "0" * 300_000, zipfile.ZIP_DEFLATED)
    data = bytearray(out.getvalue())
    if k % 17 == 0:
        return bytes(data[:-5])
    if k % 19 == 0:
        return b"\0" * 257 + b"ustar" + b"\0" * 250
    if k % 23 == 0:
        data[-14] ^= 1  # entries on this disk
    if k % 29 == 0 and (at := bytes(data).find(b"PK\x01\x02")) >= 0:
        data[at + 8] |= 1
    return bytes(data) if k % 31 else b"PK\x03\x04 before" + bytes(data)


_CRC = "CASE i " + " ".join(f"WHEN {i} THEN {zlib.crc32(b.encode())}" for i, b in enumerate(_BODIES)) + " END"


@query("s013_archive_directories", f"""WITH p AS (SELECT p_partkey AS k, 'b' || p_partkey % 16 || '/a' || p_partkey AS archive FROM part),
m AS (SELECT k, i AS ordinal, 'd/f' || i AS name, {_CRC} AS crc, i AS size FROM p, range(5) r(i) WHERE i < k % 6 UNION ALL SELECT k, 6, '../up', 0, 0 FROM p WHERE k % 7 = 0 UNION ALL SELECT k, 7 + i, CASE i WHEN 0 THEN 'Same' ELSE 'sAME' END, 0, 0 FROM p, range(2) r(i) WHERE k % 11 = 0 UNION ALL SELECT k, 9, 'zeros', 0, 300000 FROM p WHERE k % 13 = 0),
f AS (SELECT k, min(ordinal) AS first, count(*) AS n, sha256('[' || string_agg('{{"crc":' || crc || ',"name":"' || name || '","size":' || size || '}}', ',' ORDER BY name) || ']') AS id FROM m GROUP BY 1),
w AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(id, sha256('[]')) AS id, CASE WHEN k % 17 = 0 THEN 'ARCHIVE_MALFORMED' WHEN k % 19 = 0 THEN 'UNSUPPORTED_FORMAT' WHEN k % 23 = 0 THEN 'ARCHIVE_MALFORMED'
  WHEN k % 29 = 0 AND n > 0 AND NOT (first = 6) THEN 'ARCHIVE_ENCRYPTED' WHEN k % 7 = 0 THEN 'ARCHIVE_PATH_UNSAFE' WHEN k % 11 = 0 THEN 'ARCHIVE_DUPLICATE_MEMBER' WHEN k % 13 = 0 THEN 'RESOURCE_LIMIT_REACHED' END AS limitation FROM p LEFT JOIN f USING (k))
SELECT archive, CASE WHEN k % 19 = 0 AND k % 17 > 0 THEN 'TAR' ELSE 'ZIP' END AS format, CASE WHEN k % 19 = 0 AND k % 17 > 0 THEN 'OPAQUE' WHEN limitation IS NULL THEN 'INSPECTED' ELSE 'LIMITED' END AS status, limitation, CASE WHEN limitation IS NULL THEN n END AS member_count, CASE WHEN limitation IS NULL THEN 'zip-manifest-v1:' || id END AS member_manifest_id FROM w""")
def _(t):
    p = t("part").select("p_partkey")
    root = scratch.folder(p.sparkSession, "archives")
    _write(p, root, lambda row: (f"b{row.p_partkey % 16}/a{row.p_partkey}", archive_bytes(int(row.p_partkey))))
    # the folders hold a sixteenth of all parts each, however many these are: no bound on a folder's entries
    return archives.observations(archives.read_archives(p.sparkSession, root, max_entries=sys.maxsize))


@query("s010_canonical_sink", f"""WITH n AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS part, '{{"doc_id":' || doc_id || ',"lang":' || {_esc('lang')} || ',"n_chars":' || n_chars || ',"source":' || {_esc('source')} || ',"text":' || {_esc('text')} || '}}' || chr(10) AS line FROM documents)
SELECT printf('part-%06d.jsonl', part) AS name, CAST(sum(strlen(line)) AS BIGINT) AS bytes, count(*) AS records, sha256(string_agg(line, '' ORDER BY doc_id)) AS sha256 FROM n GROUP BY part""")
def _(t):
    d = t("documents").select("doc_id", "lang", "n_chars", "source", "text")  # the columns of the SQL, whatever else the table has
    path = os.path.join(scratch.folder(d.sparkSession, "canonical"), "run")
    canonical.write_canonical(d, path, ["doc_id"], part_rows=300)
    files = d.sparkSession.read.json(os.path.join(path, canonical.MANIFEST), schema="files array<struct<bytes:long,name:string,records:long,sha256:string>>")
    return files.select(F.explode("files").alias("f")).select("f.name", "f.bytes", "f.records", "f.sha256")


@query("s007_strict_jsonl", "SELECT 'turns-' || conv_id % 5 || '.jsonl' AS file, count(*) AS records, CAST(sum(turn) AS BIGINT) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def _(t):
    c = t("conversations")
    root = scratch.folder(c.sparkSession, "records")
    lines = c.select((F.col("conv_id") % 5).alias("k"), F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("j"))
    files = lines.groupBy("k").agg(F.array_join(F.collect_list("j"), "\n").alias("b"))
    _write(files, root, lambda row: (f"turns-{row.k}.jsonl", row.b.encode() + b"\n"))
    r = strict.read_jsonl(c.sparkSession, root, "conv_id long, turn int, role string, text string")
    return r.groupBy("file").agg(F.count("*").alias("records"), F.sum("turn").alias("turns"), F.sum(F.length("text")).alias("chars"))


# a line for each document, faulty in eleven ways, in words that both engines read alike
_LINE = """CASE doc_id % 13 WHEN 0 THEN '{"a":' || doc_id || ',"a":2}' WHEN 1 THEN '{"x":[{"k":1,"k":' || doc_id || '}]}' WHEN 2 THEN '{"a":NaN}' WHEN 3 THEN '{"a":[1,-Infinity]}' WHEN 4 THEN '{"a":' || doc_id || '} {' WHEN 5 THEN '[' || doc_id || ']' WHEN 6 THEN '' WHEN 7 THEN '{"a":0' || doc_id || '}' WHEN 8 THEN '"' || lang || '"' WHEN 9 THEN '{"a":1,}' WHEN 10 THEN '{"a":"' || lang ELSE '{"id":' || doc_id || ',"in":{"lang":"' || lang || '","n":[' || n_chars || ',null,1.5e3]}}' END"""


@query("s007_strict_lines", "SELECT doc_id, doc_id % 13 IN (0, 1, 11, 12) AS strict, doc_id % 13 IN (11, 12) AS strict_unique FROM documents")
def _(t):
    d = t("documents").select("doc_id", F.expr(_LINE).alias("j"))
    return d.select("doc_id", strict.strict_object(F.col("j")).isNotNull().alias("strict"), strict.strict_object(F.col("j"), unique=True).isNotNull().alias("strict_unique"))


@query("s008_record_arrays", "SELECT s_nationkey AS nation, s_suppkey AS supplier, s_name AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS pos FROM supplier")
def _(t):
    s = t("supplier")
    root = scratch.folder(s.sparkSession, "arrays")
    rows = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))))).alias("j"))
    _write(rows, root, lambda row: (f"cases-{row.k}.json", row.j.encode()))
    return strict.read_array(s.sparkSession, root, "nation int, supplier int, name string", ["supplier", "nation", "name"]).select("nation", "supplier", "name", "pos")


@query("s009_manifests", """SELECT 'p' || p_partkey || '/' || CASE p_partkey % 3 WHEN 0 THEN 'experiment-manifest.json' WHEN 1 THEN 'relationship-manifest.json' ELSE 'document-manifest.json' END AS path,
 CASE WHEN p_partkey % 5 < 3 THEN '{"id":' || p_partkey || ',"name":"' || p_name || '"}' END AS json, CASE p_partkey % 3 WHEN 0 THEN 'EXPERIMENT' WHEN 1 THEN 'RELATIONSHIP' ELSE 'DOCUMENT' END || CASE p_partkey % 5 WHEN 3 THEN '_MANIFEST_MALFORMED' WHEN 4 THEN '_MANIFEST_SIZE_LIMIT' END AS limitation FROM part""")
def _(t):
    p = t("part").select("p_partkey", "p_name")
    root, names = scratch.folder(p.sparkSession, "manifests"), list(strict.MANIFESTS)

    def entry(row):
        k = int(row.p_partkey)
        body = f'{{"id":{k},"name":"{row.p_name}"}}'.encode()
        return f"p{k}/{names[k % 3]}", (b"[" + body + b"]" if k % 2 else b"\xff" + body) if k % 5 == 3 else body + b" " * 5000 if k % 5 == 4 else body

    _write(p.repartition(p.sparkSession.sparkContext.defaultParallelism), root, entry)  # a small table is read by one task
    return strict.read_manifests(p.sparkSession, root, limit=4000).select("path", "json", "limitation")


@query("s014_linked_graph", """WITH e AS (SELECT '#part/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, '{"@id":"#part/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '","@type":["CreativeWork"],"name":"' || p_name || '","size":' || p_size || '}' AS j FROM part),
d AS (SELECT '{"@context":["c",{"x":"y"}],"@graph":[{"@id":"ro-crate-metadata.json","about":{"@id":"./"}},{"@id":"./","@type":["Dataset"],"hasPart":[' || string_agg('{"@id":"' || id || '"}', ',' ORDER BY id) || '],"name":"all","z":false},' || string_agg(j, ',' ORDER BY id) || ']}' AS d FROM e)
SELECT CAST(strlen(d) AS BIGINT) AS bytes, sha256(d) AS sha256 FROM d""")
def _(t):
    p = t("part")
    p = p.repartition(p.sparkSession.sparkContext.defaultParallelism)  # a small table is read by one task
    key = F.concat(F.lit("#part/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    body = F.to_json(F.struct(key.alias("@id"), F.array(F.lit("CreativeWork")).alias("@type"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    e = canonical_json(p.select(key.alias("id"), body.alias("b")), "b", "json").select("id", "json")
    root = scratch.folder(p.sparkSession, "graph")
    canonical.write_graph(e, os.path.join(root, "parts"), ["c", {"x": "y"}], {"@id": "ro-crate-metadata.json", "about": {"@id": "./"}}, {"@id": "./", "@type": ["Dataset"], "name": "all", "z": False}, part_rows=500)
    canonical.join_parts(os.path.join(root, "parts"), os.path.join(root, "graph.json"))
    return p.sparkSession.read.format("binaryFile").load(os.path.join(root, "graph.json")).select(F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
