"""Entity resolution: candidates for a title, their scores, and the choice among them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.claims import claim_dates, linked_ids, preferred
from ..functions.fold import distinct_words, match_fold
from ..functions.scoring import jaccard, match_bonus, match_score, sequence_ratio
from ..functions.text import text_or_empty
from ..functions.titles import aggressive_title, conservative_title, evidence_key
from ..session import cut_lineage
from .dedupe import top_per_key
from .salting import salted_join

# --- Fixed values -----------------------------------------------------------
DOMAIN_ID = "Q7889"
DOMAIN_PHRASE = "video game"
THRESHOLD, MARGIN = 0.90, 0.08
MIN_SHARED_WORDS = 0.4
PROPERTIES = {"genres": "P136", "developers": "P178", "publishers": "P123", "platforms": "P400"}
TYPE_PROPERTY, DATE_PROPERTY = "P31", "P577"
NO_EVIDENCE = "no metadata evidence found"
DECISION_FORMAT = "ambiguous metadata match: best=%.3f, second=%.3f, game_like=%d, complete=%d"
# -----------------------------------------------------------------------------

#: A title that contains another and shares few words comes within the margin of an accepted
#: score only with a sequence ratio over 0.84, so it is at most this much longer.
LONGEST_CONTAINING = 1.4
#: Rows of one word that one task joins; words with more are split.
HOT_WORD = 20_000
#: Titles whose keys are sent to every task.
FEW_TITLES = 100_000


# --- candidates ------------------------------------------------------------------


def dictionary(entities: DataFrame) -> DataFrame:
    """Entity id to label, in language preference."""
    return entities.select("id", preferred(F.col("labels")).alias("label")).filter(F.col("label").isNotNull())


def decode_lists(rows: DataFrame, key: str, lists: list[str], labels: DataFrame) -> DataFrame:
    """Replace linked ids by labels, order kept; an unknown id stays as it is."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("ids")) for n in lists])
    flat = rows.select(key, F.explode(pairs).alias("_l")).select(
        key, F.col("_l.name").alias("name"), F.posexplode("_l.ids").alias("pos", "linked")
    )
    # A linked id can stand in a large share of all rows.
    named = salted_join(flat, labels.select(F.col("id").alias("linked"), "label"), ["linked"], "left")
    item = F.struct("pos", F.coalesce("label", "linked").alias("text"))

    def gathered(name: str) -> Column:
        sorted_items = F.array_sort(F.collect_list(F.when(F.col("name") == name, item)))
        return F.transform(sorted_items, lambda x: x["text"]).alias(name)

    decoded = named.groupBy(key).agg(*[gathered(n) for n in lists])
    empty = F.array().cast("array<string>")
    return rows.drop(*lists).join(decoded, key, "left").withColumns({n: F.coalesce(n, empty) for n in lists})


def build_candidates(entities: DataFrame, labels: DataFrame, source: str, url_prefix: str) -> DataFrame:
    """Candidate fields out of external entities, linked ids decoded."""
    raw = entities.select(
        F.lit(source).alias("source"),
        F.concat(F.lit(url_prefix), "id").alias("url"),
        "id",
        preferred(F.col("labels")).alias("label"),
        F.coalesce(preferred(F.col("descriptions")), F.lit("")).alias("description"),
        linked_ids(F.col("claims"), TYPE_PROPERTY).alias("instance_of"),
        claim_dates(F.col("claims"), DATE_PROPERTY).alias("release_dates"),
        *[linked_ids(F.col("claims"), prop).alias(name) for name, prop in PROPERTIES.items()],
    )
    return decode_lists(raw, "id", list(PROPERTIES), labels)


def title_pairs(left: DataFrame, right: DataFrame, share: float = MIN_SHARED_WORDS) -> DataFrame:
    """Pairs of distinct folded titles whose word overlap is at least ``share``: ``left, right``.

    Both inputs have a column ``title`` of folded titles. An exact set-similarity join:
    words are ordered rarest first over both sides, and two titles that overlap enough
    must meet in the first ``n - ceil(share * n) + 1`` words of each. Short titles still
    meet at frequent words; a word of more than ``HOT_WORD`` titles is split by a hash of
    the left title. With the default share the pairs that are left out and can come within
    the margin of an accepted one contain each other, see ``contained_pairs``.
    """
    lw = cut_lineage(left.select("title").distinct()).withColumn("words", distinct_words("title")).filter(F.size("words") > 0)
    rw = cut_lineage(right.select("title").distinct()).withColumn("words", distinct_words("title")).filter(F.size("words") > 0)
    frequency = (
        lw.select(F.explode("words").alias("word"))
        .unionAll(rw.select(F.explode("words").alias("word")))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )

    def heads(side: DataFrame) -> DataFrame:
        ranked = (
            side.select("title", F.explode("words").alias("word"))
            .join(frequency, "word")
            .groupBy("title")
            .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
        )
        n = F.size("ranked")
        depth = n - F.ceil(n * share - 1e-9).cast("int") + 1
        words = F.transform("ranked", lambda r: r["word"])
        head = ranked.select(
            "title", words.alias("words"), F.slice(words, F.lit(1), depth).alias("head"), F.slice("ranked", F.lit(1), depth).alias("keys")
        )
        keyed = head.select("title", "words", "head", F.explode("keys").alias("key"))
        parts = F.ceil(F.col("key.df") / HOT_WORD)
        return keyed.select("title", "words", "head", F.col("key.word").alias("word"), parts.alias("parts"))

    a = heads(lw).select(
        "word", F.pmod(F.xxhash64("title"), F.col("parts")).alias("part"),
        F.col("title").alias("left"), F.col("words").alias("_lw"), F.col("head").alias("_lh"),
    )
    b = heads(rw).select(
        "word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.col("title").alias("right"), F.col("words").alias("_rw"), F.col("head").alias("_rh"),
    )
    first_meeting = F.get(F.array_intersect("_lh", "_rh"), F.lit(0)) == F.col("word")
    sizes = (F.size("_lw") >= F.size("_rw") * share) & (F.size("_rw") >= F.size("_lw") * share)
    met = a.join(b, ["word", "part"]).filter(sizes & first_meeting)
    return met.filter(jaccard(F.col("_lw"), F.col("_rw")) >= share).select("left", "right")


def contained_pairs(left: DataFrame, right: DataFrame, longest: float = LONGEST_CONTAINING) -> DataFrame:
    """Pairs of distinct folded titles of which one contains the other: ``left, right``.

    The longer one has at most ``longest`` times the letters. The shorter title is keyed by
    the rarest of its 3-grams, the longer one by all of its own. Titles under three letters
    are left out; ``title_pairs`` has them where they are equal.
    """

    def grams(side: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(1), F.length("title") - 2)
        found = F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("title"), i, F.lit(3))))
        return cut_lineage(side.select("title").distinct().filter(F.length("title") >= 3)).select("title", F.explode(found).alias("gram"))

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        frequency = long.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        keyed = short.join(frequency, "gram", "left").groupBy(F.col("title").alias("short")).agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("key")
        )
        fits = (F.length("title") <= F.length("short") * longest) & F.col("title").contains(F.col("short"))
        keyed = keyed.select("short", F.col("key.gram").alias("gram"))
        return salted_join(long, keyed, ["gram"]).filter(fits).select("short", F.col("title").alias("long"))

    a, b = grams(left), grams(right)
    one = inside(a, b).select(F.col("short").alias("left"), F.col("long").alias("right"))
    two = inside(b, a).select(F.col("long").alias("left"), F.col("short").alias("right"))
    return one.unionByName(two).distinct()


def titled_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates keyed by folded label, written once for the searches that follow."""
    return cut_lineage(
        candidates.select(match_fold("label").alias("right"), F.struct(*candidates.columns).alias("candidate"))
    )


def find_candidates(titles: DataFrame, known: DataFrame) -> DataFrame:
    """Evidence for every distinct ``query``: ``query, candidate``.

    ``known`` comes from ``titled_candidates``. Every candidate is listed that can be
    accepted, or come so near to an accepted one that the choice is not clear.
    """
    asked = cut_lineage(titles.select("query").distinct().withColumn("left", match_fold("query")))
    left, right = asked.select(F.col("left").alias("title")), known.select(F.col("right").alias("title"))
    pairs = title_pairs(left, right).unionByName(contained_pairs(left, right)).distinct()
    return asked.join(pairs, "left").join(known, "right").select("query", "candidate")


def two_pass(titles: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Search by cleaned title; a ``title`` without any hit is searched once more by base title.

    ``find`` maps ``query`` rows to ``query, candidate`` rows: an entity table lookup, or
    any other provider of evidence, which may also tell of an ``error`` that is
    ``transient`` or not. The answers are written before they are used, because a provider
    may be costly and need not repeat itself. Returns ``title, candidate, error,
    transient``; a title with an error is not searched again.
    """
    first = titles.select("title", conservative_title("title").alias("query")).distinct()

    def asked(queries: DataFrame) -> DataFrame:
        found = with_errors(find(queries.select("query")))
        return queries.join(found, "query").select("title", "candidate", "error", "transient")

    hits = cut_lineage(asked(first))
    missed = first.join(hits.select("title"), "title", "left_anti").withColumn("base", aggressive_title("title"))
    second = missed.filter((F.col("base") != "") & (F.lower("base") != F.lower("query"))).select(
        "title", F.col("base").alias("query")
    )
    return hits.unionByName(cut_lineage(asked(second)))


def with_errors(found: DataFrame) -> DataFrame:
    """Answers of a provider with the columns ``error`` and ``transient``, null where it has none."""
    kinds = {"error": "string", "transient": "boolean"}
    return found.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in found.columns})


def search_errors(found: DataFrame) -> DataFrame:
    """``title, error, transient`` of the titles whose search failed."""
    bad = found.filter(F.col("error").isNotNull())
    return bad.groupBy("title").agg(F.min("error").alias("error"), F.min(F.coalesce("transient", F.lit(False))).alias("transient"))


# --- scoring ---------------------------------------------------------------------


def is_domain(candidate: Column, domain_id: str = DOMAIN_ID, phrase: str = DOMAIN_PHRASE) -> Column:
    """Of the wanted type, by type id or by description."""
    typed = F.coalesce(F.array_contains(candidate["instance_of"], domain_id), F.lit(False))
    return typed | F.lower(text_or_empty(candidate["description"])).contains(phrase)


def is_complete(candidate: Column) -> Column:
    """Everything a gated decision needs to copy from a candidate."""
    named = F.lit(True)
    for name in ("id", "label", "url"):
        named = named & (text_or_empty(candidate[name]) != "")
    return named & is_domain(candidate) & _filled(candidate["release_dates"]) & _filled(candidate["genres"])


def _filled(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Score ``(id, pos, title, candidate)`` rows; ``title`` is the cleaned source title.

    The sequence ratio is the only part that leaves the JVM, and only for inexact pairs.
    """
    c = F.col("candidate")
    folded = pairs.withColumn("_title", match_fold("title")).withColumn("_label", match_fold(c["label"]))
    exact = F.col("_title") == F.col("_label")
    ratio = sequence_ratio(F.when(~exact, F.col("_title")), F.when(~exact, F.col("_label")))
    companies = _filled(c["developers"]) | _filled(c["publishers"])
    bonus = match_bonus(is_domain(c), _filled(c["release_dates"]), _filled(c["genres"]), companies)
    words = jaccard(distinct_words("_title"), distinct_words("_label"))
    with_ratio = folded.withColumn("_ratio", ratio)
    return (
        with_ratio.withColumn("exact", exact)
        .withColumn("score", match_score(F.col("_title"), F.col("_label"), F.col("_ratio"), words, bonus))
        .withColumn("domain", is_domain(c))
        .withColumn("complete", _filled(c["release_dates"]) & _filled(c["genres"]))
        .drop("_title", "_label", "_ratio")
    )


def choose(scored: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Best candidate per job and whether it is accepted.

    Accepted: score at the threshold, of the wanted type, complete, and either an exact
    title or clear of the runner-up by ``margin``. Ties go to the earlier candidate.
    """
    top = top_per_key(scored, ["id"], [F.desc("score"), F.col("pos")], 2)
    best = F.col("rank") == 1
    row = F.struct("candidate", "score", "domain", "complete", "exact")
    picked = top.groupBy("id").agg(
        F.max_by(F.when(best, row), best.cast("int")).alias("b"),
        F.coalesce(F.max(F.when(~best, F.col("score"))), F.lit(0.0)).alias("second"),
    )
    b = F.col("b")
    clear = b["exact"] | (b["score"] - F.col("second") >= margin)
    accepted = (b["score"] >= threshold) & b["domain"] & b["complete"] & clear
    reason = F.format_string(
        DECISION_FORMAT, b["score"], F.col("second"), b["domain"].cast("int"), b["complete"].cast("int")
    )
    return picked.select(
        "id",
        F.when(accepted, b["candidate"]).alias("candidate"),
        b["score"].alias("confidence"),
        "second",
        accepted.alias("accepted"),
        F.when(accepted, "accepted").otherwise(reason).alias("reason"),
    )


def decide(
    jobs: DataFrame,
    cache: DataFrame,
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    clean: Callable[[str], Column] = aggressive_title,
) -> DataFrame:
    """Decision for every job ``(id, title)`` over the evidence cache.

    Titles that clean to the same text are scored once and the decision is joined back,
    so a title that many jobs share costs one comparison per candidate. A cached empty
    list sends its jobs to review; jobs without a cache entry are left out.
    """
    keyed = jobs.select("id", evidence_key("title").alias("search_title"), match_fold(clean("title")).alias("asked"))
    titles = keyed.select("search_title", "asked").distinct()
    pairs = titles.join(cache, "search_title").select(
        F.struct("search_title", "asked").alias("id"),
        F.col("asked").alias("title"),
        F.posexplode("evidence").alias("pos", "candidate"),
    )
    chosen = choose(scored_pairs(pairs), threshold, margin).select(
        F.col("id.search_title").alias("search_title"), F.col("id.asked").alias("asked"),
        "candidate", "confidence", "second", "accepted", "reason",
    )
    cached = cache.filter(F.col("evidence").isNotNull()).select("search_title")
    both = keyed.join(cached, "search_title", "left_semi").join(chosen, ["search_title", "asked"], "left")
    return both.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "second": F.coalesce("second", F.lit(0.0)),
            "accepted": F.coalesce("accepted", F.lit(False)),
            "reason": F.coalesce("reason", F.lit(NO_EVIDENCE)),
        }
    ).withColumn("outcome", F.when(F.col("accepted"), "done").otherwise("review")).drop("search_title", "asked")


# --- evidence cache --------------------------------------------------------------


def evidence_cache(found: DataFrame, titles: DataFrame, fetched_at: Column) -> DataFrame:
    """Cache rows ``search_title, evidence`` for searched titles; no hit is an empty list.

    A list holds all candidates that were found, best match score first. Titles whose
    search failed must not be among ``titles``: an error is no empty answer.
    """
    keys = [evidence_key("title").alias("search_title"), match_fold(aggressive_title("title")).alias("asked")]
    hits = found.filter(F.col("candidate").isNotNull())
    # Cleaning and folding a title costs more than a join, and a title stands beside each of its candidates.
    spelled = cut_lineage(hits.select("title").distinct().select("title", *keys))
    if spelled.count() <= FEW_TITLES:
        spelled = F.broadcast(spelled)
    pairs = hits.join(spelled, "title").select(F.struct("search_title", "asked").alias("id"), F.col("asked").alias("title"), "candidate")
    scored = scored_pairs(pairs.withColumn("pos", F.lit(0)))
    # A candidate found for several spellings counts once, by its best score. One shuffle serves both groupings;
    # making a sorted list distinct instead would compare all of its candidates with each other.
    by_title = scored.select(F.col("id.search_title").alias("search_title"), "candidate", "score").repartition("search_title")
    best = by_title.groupBy("search_title", "candidate").agg(F.max("score").alias("score"))
    order = F.struct((-F.col("score")).alias("least"), F.col("candidate.id").alias("key"), F.col("candidate.url").alias("url"), "candidate")
    lists = best.groupBy("search_title").agg(F.array_sort(F.collect_list(order)).alias("ranked"))
    lists = lists.select("search_title", F.transform("ranked", lambda x: x["candidate"]).alias("evidence"))
    asked = titles.select(evidence_key("title").alias("search_title")).distinct()
    kind = lists.schema["evidence"].dataType
    both = asked.join(lists, "search_title", "left")
    return both.select(
        "search_title", F.coalesce("evidence", F.array().cast(kind)).alias("evidence"), fetched_at.alias("fetched_at")
    )


def cache_lookup(jobs: DataFrame, cache: DataFrame, columns: Sequence[str] = ("evidence",)) -> DataFrame:
    """Jobs with ``columns`` of their cache rows, by default their evidence; these are null on a miss."""
    keyed = jobs.withColumn("search_title", evidence_key("title"))
    return keyed.join(cache.select("search_title", *columns), "search_title", "left")


def results_of(decisions: DataFrame, method: str, notes: str, version: int, checked_at: Column) -> DataFrame:
    """Result rows copied from the accepted candidates."""
    c = F.col("candidate")
    accepted = decisions.filter(F.col("candidate").isNotNull())
    raw = F.struct(F.lit(method).alias("method"), c.alias("candidate"), F.col("confidence"))
    return accepted.select(
        "id",
        c["label"].alias("canonical_title"),
        F.get(c["release_dates"], F.lit(0)).alias("release_date"),
        c["genres"].alias("genres"),
        F.get(c["developers"], F.lit(0)).alias("developer"),
        F.get(c["publishers"], F.lit(0)).alias("publisher"),
        c["platforms"].alias("platforms"),
        F.lit(None).cast("string").alias("description"),
        "confidence",
        F.filter(F.array(c["url"]), lambda u: u.isNotNull()).alias("evidence_urls"),
        F.lit(notes).alias("notes"),
        F.lit(version).alias("version"),
        checked_at.alias("checked_at"),
        F.to_json(raw).alias("raw"),
    )
