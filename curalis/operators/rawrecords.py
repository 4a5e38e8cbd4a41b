"""Records separated by NUL, as version control prints them for programs: changes, trees and status in two forms. Any malformed record spoils its payload.

Where the number of fields a record takes depends on what it says (a rename takes two paths, a commit any number of changes), a fold over the fields keeps what is expected next and the
places where records of that kind stand, which are few; the fields themselves are then read by their places. Payloads are text; a payload is one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalis.functions.columns import sorted_set
from curalis.functions.nested import let

# fixed values: shapes of ids, modes and change letters; modes of a link and of nothing; what a payload's faults and limits are called
ID = "[0-9a-f]{40,64}"
MODE = "[0-7]{6}"
CHANGE = rf"^:{MODE} {MODE} {ID} {ID} [A-Z]$"
LINK, NOTHING = "120000", "000000"
CHANGES_MALFORMED = "GIT_CHANGE_HISTORY_MALFORMED"
TREE_MALFORMED = "GIT_SECRET_HISTORY_TREE_MALFORMED"
STATUS_MALFORMED = "GIT_STATUS_MALFORMED"
HYGIENE_MALFORMED = "GIT_REPOSITORY_HYGIENE_STATUS_MALFORMED"
NOT_ORDINARY = "GIT_REPOSITORY_HYGIENE_NONORDINARY_RECORD_NOT_EVALUATED"
NOT_COMPARED = "GIT_DESTROYED_SYMLINK_CONTENT_NOT_COMPARED"
FINDING_LIMIT = "GIT_REPOSITORY_HYGIENE_FINDING_LIMIT"
MOST_FINDINGS = 256
_NUL = r"\x00"


def _fields(payload: Column) -> Column:
    """The fields of a payload, NULs at its end left out; none for an empty one."""
    body = F.regexp_replace(payload, _NUL + "+$", "")
    return F.when(payload == "", F.array().cast("array<string>")).otherwise(F.split(body, _NUL))


def _places(fields: Column) -> Column:
    return F.arrays_zip(fields.alias("t"), F.sequence(F.lit(0), F.greatest(F.size(fields) - 1, F.lit(0))).alias("i"))


def changed_paths(payload: Column, commits: Column) -> Column:
    """struct(limitation, changes array<struct(commit, paths)>) of raw changes of the commits asked for, in their order.

    A commit stands where a record may begin; of anything else that stands there, and of no path, the shape is asked."""

    def parse(fields: Column) -> Column:
        start = F.struct(F.lit(False).alias("path"), F.lit(False).alias("bad"), F.array().cast("array<int>").alias("at"))

        def step(a, x):
            named = ~a["path"] & F.coalesce(F.get(commits, F.size(a["at"])) == x["t"], F.lit(False))
            change = ~a["path"] & ~named & (F.size(a["at"]) > 0) & x["t"].rlike(CHANGE)
            return F.struct(change.alias("path"), (a["bad"] | ~(a["path"] | named | change)).alias("bad"), F.when(named, F.concat(a["at"], F.array(x["i"]))).otherwise(a["at"]).alias("at"))

        def told(s: Column) -> Column:
            ends = F.concat(F.slice(s["at"], 2, F.size(s["at"])), F.array(F.size(fields)))
            paths = lambda a, e: sorted_set(F.transform(F.filter(F.sequence(a + 1, F.greatest(a + 1, e - 1)), lambda i: (i < e) & ((i - a) % 2 == 0)), lambda i: F.get(fields, i)))
            changes = F.transform(F.arrays_zip(commits.alias("c"), s["at"].alias("a"), ends.alias("e")), lambda z: F.struct(z["c"].alias("commit"), paths(z["a"], z["e"]).alias("paths")))
            bad = s["bad"] | s["path"] | (F.size(s["at"]) != F.size(commits))
            none = F.filter(changes, lambda z: F.lit(False))
            return F.struct(F.when(bad, CHANGES_MALFORMED).alias("limitation"), F.when(bad, none).otherwise(changes).alias("changes"))

        return let(F.when(F.size(fields) == 0, start).otherwise(F.aggregate(_places(fields), start, step)), told)

    return let(_fields(payload), parse)


def tree_blobs(payload: Column, requested: Column) -> Column:
    """struct(limitation, blobs array<struct(path, blob, size)>) of the ordinary files among a tree's records; each must name a path that was asked for."""
    ok = rf"(?s)^\s*{MODE}\s+\S+\s+{ID}\s+\S+\s*\t.*$"
    plain = r"(?s)^\s*100(?:644|755)\s"
    whole = rf"(?s)^\s*100(?:644|755)\s+blob\s+({ID})\s+([0-9]+)\s*\t(.*)$"

    def parse(fields: Column) -> Column:
        path = lambda t: F.regexp_extract(t, r"(?s)^[^\t]*\t(.*)$", 1)
        good = F.forall(fields, lambda t: t.rlike(ok) & F.array_contains(requested, path(t)) & (~t.rlike(plain) | t.rlike(whole)))
        blobs = F.transform(F.filter(fields, lambda t: t.rlike(plain)), lambda t: F.struct(path(t).alias("path"), F.regexp_extract(t, whole, 1).alias("blob"), F.nullif(F.regexp_extract(t, whole, 2), F.lit("")).cast("long").alias("size")))
        none = F.filter(blobs, lambda x: F.lit(False))
        return F.struct(F.when(~good, TREE_MALFORMED).alias("limitation"), F.when(good, sorted_set(blobs)).otherwise(none).alias("blobs"))

    return let(_fields(payload), parse)


def status_codes(payload: Column) -> Column:
    """struct(limitation, codes array<struct(path, code)>): two letters for each path, the last of a path's records; here a malformed record alone is left out."""
    fields = F.filter(F.split(payload, _NUL), lambda t: t != "")
    good = F.filter(fields, lambda t: t.rlike(r"(?s)^[\x00-\x7F]{2} ."))
    rows = F.transform(good, lambda t: F.struct(F.substring(t, F.lit(4), F.length(t)).alias("path"), F.substring(t, 1, 2).alias("code")))

    def told(r: Column) -> Column:
        paths = F.transform(r, lambda x: x["path"])
        last = F.filter(F.arrays_zip(r.alias("r"), F.sequence(F.lit(1), F.size(r)).alias("i")), lambda z: ~F.array_contains(F.slice(paths, z["i"] + 1, F.size(paths)), z["r"]["path"]))
        rows = F.when(F.size(paths) == F.size(F.array_distinct(paths)), r).otherwise(F.transform(last, lambda z: z["r"]))
        return F.struct(F.when(F.size(good) < F.size(fields), STATUS_MALFORMED).alias("limitation"), F.array_sort(rows).alias("codes"))

    return let(rows, told)


def hygiene_status(payload: Column) -> Column:
    """struct(limitations, added, findings, count) of the second status form: paths added to the index, and of links that are something else now the first by path, with how many there are."""
    hashes, modes = rf"{ID} {ID}", rf"{MODE} {MODE} {MODE}"
    ordinary = rf"(?s)^1 [^ ]{{2}} [^ ]{{4}} {modes} {hashes} .+$"
    rename = rf"(?s)^2 [^ ]{{2}} [^ ]{{4}} {modes} {hashes} [RC][0-9]+ .+$"
    unmerged = rf"(?s)^u [^ ]{{2}} [^ ]{{4}} {modes} {MODE} {hashes} {ID} .+$"
    other = r"(?s)^[?!] ."

    def parse(fields: Column) -> Column:
        start = F.struct(F.lit(False).alias("second"), F.array().cast("array<int>").alias("at"))
        step = lambda a, x: F.struct((~a["second"] & x["t"].startswith("2 ")).alias("second"), F.when(a["second"], F.concat(a["at"], F.array(x["i"]))).otherwise(a["at"]).alias("at"))

        def told(s: Column) -> Column:
            first = F.transform(F.filter(_places(fields), lambda x: ~F.array_contains(s["at"], x["i"])), lambda x: x["t"])
            empty = F.exists(F.transform(s["at"], lambda i: F.get(fields, i)), lambda t: t == "")
            return let(first, lambda e: read(e, s["second"] | empty))

        def read(e: Column, cut: Column) -> Column:
            part = lambda t: F.split(t, " ", 9)  # noqa: E731  (of a good record: a path may hold blanks)
            one = F.transform(F.transform(F.filter(e, lambda t: t.startswith("1 ")), part), lambda p: F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in ((8, "path"), (1, "xy"), (3, "head"), (4, "index"), (6, "was"), (7, "now"))]))
            shape = lambda t: F.when(t.startswith("1 "), t.rlike(ordinary)).when(t.startswith("2 "), t.rlike(rename)).when(t.startswith("u "), t.rlike(unmerged)).otherwise(t.rlike(other))
            return let(F.struct(one.alias("one"), (~F.forall(e, shape) | cut).alias("bad")), lambda r: lost(e, r["one"], r["bad"]))

        def lost(e: Column, one: Column, bad: Column) -> Column:
            gone = F.filter(one, lambda x: (x["head"] == LINK) & ~x["index"].isin(LINK, NOTHING))
            paths = F.transform(one, lambda x: x["path"])
            again = let(paths, lambda p: F.size(p) != F.size(F.array_distinct(p)))
            return F.when(bad | again, none(F.array(F.lit(HYGIENE_MALFORMED)))).otherwise(let(gone, lambda x: good(e, one, x)))

        def none(limits: Column) -> Column:
            return F.struct(limits.alias("limitations"), F.array().cast("array<string>").alias("added"), F.array().cast("array<struct<path:string,index_mode:string,match_status:string>>").alias("findings"), F.lit(0).alias("count"))

        def good(e: Column, one: Column, gone: Column) -> Column:
            findings = F.array_sort(F.transform(gone, lambda x: F.struct(x["path"].alias("path"), x["index"].alias("index_mode"), F.when(x["was"] == x["now"], "CONTENT_ID_EQUAL").otherwise("MODE_CHANGE_CANDIDATE").alias("match_status"))))
            limits = F.array_compact(F.array(F.when(F.exists(gone, lambda x: x["was"] != x["now"]), NOT_COMPARED), F.when(F.size(gone) > MOST_FINDINGS, FINDING_LIMIT), F.when(F.size(one) < F.size(e), NOT_ORDINARY)))
            added = sorted_set(F.transform(F.filter(one, lambda x: x["xy"].startswith("A")), lambda x: x["path"]))
            return F.struct(limits.alias("limitations"), added.alias("added"), F.slice(findings, 1, MOST_FINDINGS).alias("findings"), F.size(gone).alias("count"))

        return let(F.when(F.size(fields) == 0, start).otherwise(F.aggregate(_places(fields), start, step)), told)

    ended = F.when((payload == "") | payload.endswith("\0"), payload).otherwise(F.lit("x\0"))  # a payload that does not end in NUL is cut off
    return let(F.when(ended == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(ended, _NUL + "$", ""), _NUL)), parse)
