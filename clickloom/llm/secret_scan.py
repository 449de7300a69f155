"""Secret scans by corpus-wide ownership frequency, in native functions only.

Candidates are found in each whole text by fixed patterns.  The SHA-256 of each
candidate's value is then counted over the whole corpus by distinct owners and
distinct repositories: a value that ``example_owners`` or more owners carry, or two owners in ``example_repositories`` or more
repositories, is a widely copied example; any other is a live-looking credential of its owner, in however many of that owner's repositories.
Base candidates (``assign``, ``access``, ``hex``) are always reported; candidates
of the further kinds (``vendor``, ``pem``, ``opaque``) are reported only
where their ownership makes them live-looking and no base span overlaps them.

Defined cases: a null or empty text has no candidates; a null owner or
repository counts as one unnamed owner; repeated rows give a row each; rows with
a null id are scanned like any other; an empty table gives an empty result.
Spans are in code points, end exclusive.  Values never leave the scan, only
their digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

# Kind, pattern, group that holds the value, least length of the value, further test of the value.
ASSIGN = r"(?:(?i)(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
VENDOR = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"
)
KINDS = [
    ("assign", ASSIGN, 2, 6, None),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, None),
    ("hex", r"[0-9a-f]{24,}", 0, 24, None),
    ("vendor", VENDOR, 0, 0, None),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, None),
    ("opaque", r"[A-Za-z0-9_+=-]{24,}", 0, 24, r"^(?=(?:[^0-9]*[0-9]){3})(?=(?:[^A-Z]*[A-Z]){3})(?=(?:[^a-z]*[a-z]){3})"),
]
N_BASE = 3
SPAN = "struct<start:int,kind:int,end:int,digest:string>"
MASK = "[SECRET]"
#: Characters of the pieces that texts are masked in, pieces that are looked up together, and values of a run.
PIECE, PIECES, RUN = 1024, 64, 128
#: Rows with candidates for each salt of a value.
ROWS_A_SALT = 100_000


def running(values: Column, start: Column, combine) -> Column:
    """For each value the combination of ``start`` and all values up to it.

    Values are taken in runs of ``RUN`` and each run grows from what stands before it, as an array that grows by one is copied each time:
    n values cost about n * RUN and (n / RUN)**2 copies, not n**2.
    """
    grown = lambda x, first: F.aggregate(
        x, F.array(first), lambda acc, v: F.array_append(acc, combine(F.element_at(acc, -1), v))
    )

    def over(cut: Column) -> Column:
        whole = F.transform(cut, lambda x: F.aggregate(x, start, combine))
        return let(grown(whole, start), lambda before: F.flatten(F.transform(cut, lambda x, i: F.slice(grown(x, F.get(before, i)), 2, RUN))))

    def runs(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda b: F.slice(v, b * RUN + 1, RUN))

    return let(values, lambda v: F.when(F.size(v) > 0, let(runs(v), over)).otherwise(v))


def _plus(a: Column, b: Column) -> Column:
    return (a + b).cast("int")


def _of_kind(text: Column, k: int) -> Column:
    """Spans of one kind: the texts between the matches and the matches give the places, by running sums of their lengths."""
    _, pattern, group, least, test = KINDS[k]
    regex, none = F.lit(pattern), F.array().cast(f"array<{SPAN}>")

    def placed(m: Column, values: Column, gaps: Column) -> Column:
        def span(end: Column, i: Column) -> Column:
            value = F.get(values, i)
            good = F.length(value) >= least
            if test:
                good = good & value.rlike(test)
            found = F.struct((end - F.length(F.get(m, i))).alias("start"), F.lit(k).alias("kind"), end.alias("end"), F.sha2(value, 256).alias("digest"))
            return F.when(good, found.cast(SPAN))

        lengths = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))
        return let(running(lengths, F.lit(0), _plus), lambda ends: F.filter(F.transform(ends, span), lambda s: s.isNotNull()))

    found = let(
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda m: let(
            F.regexp_extract_all(text, regex, F.lit(group)),
            lambda v: let(F.split(text, pattern, -1), lambda g: placed(m, v, g)),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(none)


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``, in order.

    Among all spans in order of their starts, one is free if no earlier base span ends behind its start and the next base
    span starts behind its end.
    """
    is_base = lambda s: s["kind"] < N_BASE
    far = F.lit(2**31 - 1)

    def free(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        starts = F.transform(F.reverse(spans), lambda s: F.when(is_base(s), s["start"]).otherwise(far))
        kept = lambda e: let(
            F.reverse(running(starts, far, lambda a, b: F.least(a, b))),
            lambda f: F.filter(
                F.transform(spans, lambda s, i: F.when(~is_base(s) & (F.get(e, i) <= s["start"]) & (F.get(f, i) >= s["end"]), s)), lambda s: s.isNotNull()
            ),
        )
        return let(ends, kept)

    alone = F.when((F.size(more) == 0) | (F.size(base) == 0), F.sort_array(more))
    return alone.otherwise(let(F.sort_array(F.concat(base, more)), free))


def scan(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """All columns of ``docs`` in ``row``, with owner, repository and the candidate spans of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.expr(repository).cast("string"), F.lit("")).alias("repository"),
        F.concat(*[_of_kind(text, k) for k in range(N_BASE)]).alias("base"),
        F.concat(*[_of_kind(text, k) for k in range(N_BASE, len(KINDS))]).alias("more"),
    )
    return found.select("row", "owner", "repository", F.sort_array("base").alias("base"), apart(F.col("more"), F.col("base")).alias("more"))


def ownership(candidates: DataFrame, example_owners: int = 3, example_repositories: int = 6) -> DataFrame:
    """(digest, owners, repositories) of the widely copied values of (digest, owner, repository).

    Repeats are summed before anything is shuffled, so a value that a third of all rows carry is a few rows.
    """
    once = candidates.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    return (
        once.groupBy("digest")
        .agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
        .where((F.col("owners") >= example_owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= example_repositories)))
    )


def _judged(scanned: DataFrame, example_owners: int) -> DataFrame:
    """(rid, live, n_live, n_example): the live-looking spans of each row that has candidates."""
    spans = scanned.where((F.size("base") > 0) | (F.size("more") > 0)).select(
        "rid", "owner", "repository", F.explode(F.concat("base", "more")).alias("s")
    )
    spans = spans.select("rid", "owner", "repository", "s", F.col("s.digest").alias("digest"))
    # a value's rows are dealt over as many tasks as there are rows, each of which gets the value's verdict
    salts = int(-(-scanned.where((F.size("base") > 0) | (F.size("more") > 0)).count() // ROWS_A_SALT)) or 1
    salt = F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int")
    known = ownership(spans, example_owners).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    status = spans.withColumn("salt", salt).join(known, ["digest", "salt"], "left").select("rid", "s", F.col("owners").isNull().alias("live"))
    return status.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.when(F.col("live"), F.col("s")))).alias("live"),
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x[0]) for x in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "concat_ws('/', source, lang)", example_owners: int = 3) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans, and how many are live-looking or examples."""
    scanned = staged(
        scan(docs.select("doc_id", "text", "source", "lang"), owner, repository).select(
            F.monotonically_increasing_id().alias("rid"), F.col("row.doc_id").cast("long").alias("doc_id"), "owner", "repository", "base", "more"
        ),
        "spans",
    )
    judged = _judged(scanned, example_owners)
    live = F.coalesce(F.col("live"), F.array().cast(f"array<{SPAN}>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.join(judged, "rid", "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", F.filter(live, lambda s: s["kind"] >= N_BASE)))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        _joined(live).alias("live_spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that sorted ``spans`` cover replaced by one mark.

    Works piece by piece, so that neither a place is counted from the text's start nor the text copied for each span.
    """

    def inside(found: Column, first: Column, size: int) -> Column:
        return F.filter(found, lambda s: (s["end"] > first) & (s["start"] < first + size))

    def cut(part: Column, size: int) -> Column:
        return F.regexp_extract_all(part, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def of_piece(piece: Column, first: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.concat(acc["out"], F.substr(piece, acc["pos"] - first + 1, s["start"] - acc["pos"]), F.lit(MASK))
            return F.struct(
                F.greatest(acc["pos"], s["end"]).cast("int").alias("pos"),
                F.when((s["start"] >= acc["pos"]) & (s["start"] >= first), gap).otherwise(acc["out"]).alias("out"),
            )

        start = F.struct(first.cast("int").alias("pos"), F.lit("").alias("out"))
        rest = lambda acc: F.concat(acc["out"], F.substr(piece, F.least(acc["pos"], first + PIECE) - first + 1, F.lit(PIECE)))
        return F.when(F.size(own) > 0, F.aggregate(own, start, step, rest)).otherwise(piece)

    def of_part(part: Column, k: Column) -> Column:
        def pieces(own: Column) -> Column:
            place = lambda i: k * PIECE * PIECES + i * PIECE
            return F.array_join(F.transform(cut(part, PIECE), lambda x, i: let(inside(own, place(i), PIECE), lambda found: of_piece(x, place(i), found))), "")

        return let(inside(spans, k * PIECE * PIECES, PIECE * PIECES), lambda own: F.when(F.size(own) > 0, pieces(own)).otherwise(part))

    return F.when(F.size(spans) > 0, F.array_join(F.transform(cut(text, PIECE * PIECES), of_part), "")).otherwise(text)


def mask_secrets(docs: DataFrame, owner: str = "source", repository: str = "concat_ws('/', source, lang)", example_owners: int = 3) -> DataFrame:
    """``docs`` with its live-looking secrets masked in ``text``; every row and column stays.

    Rows without a candidate pass unchanged and are not shuffled.
    """
    scanned = staged(scan(docs, owner, repository).select("*", F.monotonically_increasing_id().alias("rid")), "spans")
    judged = _judged(scanned, example_owners)
    clean = scanned.where((F.size("base") == 0) & (F.size("more") == 0)).select("row.*")
    found = scanned.where((F.size("base") > 0) | (F.size("more") > 0)).join(judged, "rid", "left")
    found = found.withColumn("masked", masked(F.col("row.text"), F.col("live")))
    names = [F.col("masked").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return clean.unionByName(found.select(*names))
