"""Scalar expressions: paths, tokens, sizes, identities, redaction, validation. All are JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the secret shapes that are hidden and the category names that replace them
SECRETS = [
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("GITHUB_TOKEN", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}"),
    ("JWT", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("TOKEN", r"(?i)token[ \t]*[=:][ \t]*[^\s]+"),
    ("PASSWORD", r"(?i)password[ \t]*[=:][ \t]*[^\s]+"),
    ("API_KEY", r"(?i)api_key[ \t]*[=:][ \t]*[^\s]+"),
    ("COOKIE", r"(?i)cookie[ \t]*[=:][ \t]*[^\s]+"),
]
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^\s\p{Z}\x0B\x1C-\x1F\x85A-Za-z0-9_]"
Z95 = 1.959963984540054


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def ratio(n: Column, d: Column, digits: int) -> Column:
    """n / d rounded, null where d is 0."""
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), digits)


def content_id(c: Column, scheme: str = "sha256-file-v1") -> Column:
    return F.concat(F.lit(scheme + ":"), F.sha2(c, 256))


def length_prefixed_hash(parts: Sequence[Column]) -> Column:
    """SHA-256 over parts, each behind its length as 8 big-endian bytes."""
    pieces = []
    for p in parts:
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.to_binary(p, F.lit("utf-8"))]
    return F.sha2(F.concat(*pieces), 256)


@lru_cache
def _foldings() -> tuple[list[str], list[str], dict[str, str]]:
    """Letters that folding changes: those that become one other as two lists, and those that become several. From the Unicode data."""
    one, many = {}, {}
    for k in range(0x80, 0x110000):
        c = chr(k)
        f = c.casefold()
        if f != c:
            (one if len(f) == 1 else many)[c] = f
    return list(one), list(one.values()), many


def casefold(c: Column) -> Column:
    """Full case folding: of the lower-cased text each letter that folds to another is replaced, all that the Unicode data has, also where the JVM does not know its lower case yet.

    Letters are looked up one by one only in texts that hold one of the ranges in which folding is not the JVM's lower case."""
    single, to, many = _foldings()
    table = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    several = F.array_join(F.transform(F.split(F.lower(c), ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    full = F.translate(several, "".join(single), "".join(to))
    plain = F.replace(c, F.lit("ß"), F.lit("ss"))  # common in texts, so apart from the others
    odd = c.rlike("[\u00B5\u0130\u0149\u017F\u01F0\u0345\u0390\u03A3\u03B0\u03C2\u03D0-\u03F5\u0587\u13A0-\u13FD\u1C80-\u1C8A\u1E96-\u1E9B\u1E9E\u1F50-\u1F56\u1F80-\u1FFF\u2C2F\uA7C0-\uA7DC\uAB70-\uABBF\uFB00-\uFB06\uFB13-\uFB17\\x{10570}-\\x{105BF}\\x{10D50}-\\x{10D8F}]")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(odd, full).otherwise(F.lower(plain))


def collision_key(c: Column) -> Column:
    """A path composed (NFC) and case-folded. ASCII paths stay in the JVM; only others pass through Python."""
    @F.pandas_udf("string")
    def key(x):
        import unicodedata

        return x.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).casefold())

    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(key(c))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(c), F.lit(TOKEN_PATTERN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0.0 where both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def json_string(c: Column) -> Column:
    """A JSON string with all but ASCII escaped, or null; letters outside ASCII become \\uXXXX, in pairs of surrogates where needed."""
    once = lambda value, body: F.transform(F.array(value), body)[0]
    quoted = once(F.to_json(F.array(c)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))

    def small(plain: Column) -> Column:
        for k in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # Spark writes their hexadecimal digits large
            plain = F.regexp_replace(plain, rf"(?<!\\)((?:\\\\)*)\\u{k:04X}", rf"$1\\u{k:04x}")
        return plain

    def written(plain: Column) -> Column:
        units = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(....)", r"\\u$1")
        runs = F.regexp_extract_all(plain, F.lit(r"([\x00-\x7E]+|[^\x00-\x7E]+)"), F.lit(1))
        escaped = F.array_join(F.transform(runs, lambda run: F.when(run.rlike(r"^[\x00-\x7E]"), run).otherwise(units(run))), "")
        return F.when(plain.rlike(r"[^\x00-\x7E]"), escaped).otherwise(plain)

    plain = F.when(c.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), small(quoted)).otherwise(quoted)
    return F.coalesce(F.when(c.isNotNull(), once(plain, written)), F.lit("null"))


def json_object(fields: Sequence[tuple[str, Column]]) -> Column:
    """Canonical JSON of fields whose values are JSON already (null: null), keys in order, without white space."""
    parts = []
    for i, (k, v) in enumerate(sorted(fields, key=lambda x: x[0])):
        parts += [F.lit(("," if i else "{") + f'"{k}":'), F.coalesce(v, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def size_bucket(n: Column) -> Column:
    """Half the bit length: 0 for 0."""
    return F.floor(F.length(F.bin(n)) / 2)


def suffix(path: Column) -> Column:
    """The last dot and what follows in the file name; '' for names without one or that only begin with dots."""
    return F.regexp_extract(F.lower(path), r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path == ".", F.lit(None)).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.when(path == ".", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def safe_path(path: Column) -> Column:
    """Relative, without empty, '.' or '..' parts, backslashes or control characters."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"[\\\x00-\x1F]") & F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))


def resolve_path(base: Column, path: Column) -> Column:
    """A local path that a file at `base` names, with '.' and '..' resolved; null where it is unsafe or leaves the root."""
    bad = (path == "") | (F.octet_length(path) > 4096) | path.rlike(r"[\x00-\x1F\\?#]|^/|^[A-Za-z]:")
    start = F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1)
    step = lambda acc, x: F.when(acc.isNull() | x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~bad & (F.size(parts) > 0), F.array_join(parts, "/"))


def protected(path: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (path == p) | path.startswith(p + "/")
    return hit


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def is_swhid(c: Column) -> Column:
    return F.coalesce(c.rlike("^swh:1:(cnt|dir|rev|rel|snp):[0-9a-f]{40}$"), F.lit(False))


def safe_token(c: Column, pattern: str = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$") -> Column:
    return F.when(c.rlike(pattern), c)


def secret_categories(c: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in SECRETS])))


def redact(c: Column) -> Column:
    for n, p in SECRETS:
        c = F.regexp_replace(c, p, f"[REDACTED:{n}]")
    return c


def human_size(n: Column) -> Column:
    """Bytes in thousands with one decimal, rounded as the binary value of the quotient lies, not as its shortest decimal does."""
    out, x = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))), n.cast("double")
    for i, u in enumerate(["KB", "MB", "GB", "TB"], 1):
        x = x / F.lit(1000.0)
        t = F.floor(n / F.lit(float(1000**i // 10))).cast("long")
        high = x.cast("float").cast("double")  # both parts times 20 are exact, so the sign of their distance from the middle is
        far = (high * 20 - (2 * t + 1)) + (x - high) * 20
        t = t + F.when((far > 0) | ((far == 0) & (t % 2 == 1)), 1).otherwise(0)
        text = F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(" " + u))
        out = out.when(x < 1000, text) if u != "TB" else out.otherwise(text)
    return out


def wilson_lower(successes: Column, n: Column, digits: int = 12) -> Column:
    """Lower bound of the 95 % score interval; null for n = 0."""
    p, z2 = successes / n, Z95 * Z95
    low = (p + z2 / (2 * n) - Z95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(n > 0, F.round(F.greatest(low, F.lit(0.0)), digits))


def destination(prefix: str, path: Column) -> Column:
    return F.concat(F.lit(prefix + "/"), F.substring(F.sha2(path, 256), 1, 16), F.lit("-"), basename(path))


def archive_kind(content: Column) -> Column:
    """By the first bytes; tar by its mark at offset 257."""
    head = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    return F.when(head("504B0304") | head("504B0506"), "ZIP").when(head("377ABCAF271C"), "7Z").when(head("526172211A07"), "RAR").when(F.hex(F.substring(content, 258, 5)) == "7573746172", "TAR")


def lfs_pointer(text: Column) -> Column:
    """struct(oid, size_bytes) of a large-file pointer, or null."""
    ok = text.rlike(r"^version https://git-lfs\.github\.com/spec/v1\noid sha256:[0-9a-f]{64}\nsize [0-9]+\n?$")
    return F.when(ok, F.struct(F.regexp_extract(text, "oid (sha256:[0-9a-f]{64})", 1).alias("oid"), F.regexp_extract(text, r"size ([0-9]+)", 1).cast("long").alias("size_bytes")))


def sniff(path: Column, content: Column) -> Column:
    """Format of a file by name, then by its bytes; each rule only where the earlier ones fail.

    A text that begins like JSON is JSON whether it parses or not. CSV: the first line has a comma, and of the first 1,001 lines all have as many fields,
    separated by commas outside quotes (fields with line ends inside quotes count as unequal).
    """
    name = F.lower(basename(path))
    text = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8"))
    start = F.regexp_replace(text, r"^[\s\x1C-\x1F\x85\p{Z}]+", "")
    lines = F.slice(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n"), 1, 1001)
    fields = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(F.regexp_replace(F.regexp_replace(x, '"[^"]*"', ""), "[^,]", "")))
    csv = (F.size(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")) >= 2) & F.contains(lines[0], F.lit(",")) & (F.size(fields) == F.size(lines)) & (F.array_min(fields) == F.array_max(fields))
    return (
        F.when(name == "datapackage.json", "DATA_PACKAGE").when(name.endswith(".ipynb"), "NOTEBOOK").when(F.hex(F.substring(content, 1, 5)) == "255044462D", "PDF").when(text.isNull(), "BINARY").when(start.startswith("{") | start.startswith("["), "JSON").when(csv, "CSV")
        .when(text.rlike(r"(?m)^#{1,6}\s+\S+"), "MARKDOWN").when(text.rlike(r"(?m)^(?:\d{4}-\d\d-\d\d|\[[A-Z]+\]|(?:INFO|WARN|ERROR|DEBUG)\b)"), "LOG").otherwise("TEXT"))
