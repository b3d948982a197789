"""Story dedup: normalised keys, similar-key edges, leader election, best row.

The digest merges items whose normalised headline keys are "similar":

* containment — both keys longer than 10 characters and one contains the
  other, or
* word Jaccard ≥ 0.4 with at least one shared word outside the generic list.

Keys are scanned in first-seen order and a surviving key absorbs every later
similar key not yet absorbed.  That sequential scan is the lexicographically
first maximal independent set of the similarity graph, which we compute in
parallel rounds: a key is a LEADER once all its earlier neighbours are
ABSORBED, and ABSORBED once any earlier neighbour is a LEADER.  Each round is
one join and one grouped aggregate over the edges; rounds are checkpointed.

Edges never come from a cross join:

* Jaccard candidates come from prefix filtering (the all-pairs / MapReduce
  set-similarity join of Bayardo et al. 2007 and Vernica et al. 2010, with prefixes
  that share two tokens as in Wang et al. 2012): with tokens ordered rarest first, two
  sets with J ≥ t and two or more common tokens share two among the first
  |x| − max(2, ⌈t·|x|⌉) + 2 tokens of each, and their sizes are within a factor t.
  Candidates are checked where they meet and verified exactly.  A pair of tokens
  that many keys have is split into pairs of blocks, and a position filter drops
  pairs whose remaining words cannot suffice.  Nothing is capped.
* Containment candidates: if s (≥ 11 chars) is inside l, every 11-character
  substring of s is one of l's; s probes with its rarest one, grams are
  joined and candidates verified with ``contains``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import normalise_headline, token_set
from ..session import measured, written


#: Keys of one signature that meet in one task; one of more is cut into pairs of blocks, into so many blocks at most.
TOKEN_ROWS, TOKEN_BLOCKS = 2048, 32


def story_keys(items: DataFrame) -> DataFrame:
    """T19 key per item: normalised master headline, else normalised headline or 'unknown'."""
    k1 = normalise_headline(F.coalesce(F.col("master_headline"), F.col("headline"), F.lit("")))
    k2 = normalise_headline(F.coalesce(F.col("headline"), F.lit("unknown")))
    return items.withColumn("story_key", F.when(k1 == "", k2).otherwise(k1))


def key_table(keyed: DataFrame) -> DataFrame:
    """One row per distinct key: ``(story_key, key_ord, tokens, n_tok, key_len)``."""
    k = keyed.groupBy("story_key").agg(F.min("ord").alias("key_ord"))
    return k.select("story_key", "key_ord", token_set("story_key").alias("tokens"),
                    F.length("story_key").alias("key_len")).withColumn("n_tok", F.size("tokens"))


def jaccard_pairs(keys: DataFrame, threshold: float = P.SIMILAR_JACCARD,
                  generic: Sequence[str] = P.GENERIC_WORDS, token_rows: int = TOKEN_ROWS) -> DataFrame:
    """Key pairs (a < b by key_ord) with Jaccard ≥ t and a shared non-generic word."""
    return _jaccard_hits(keys, threshold, generic, token_rows).distinct().select("a", "b", "jaccard")


def _jaccard_hits(keys: DataFrame, threshold: float = P.SIMILAR_JACCARD,
                  generic: Sequence[str] = P.GENERIC_WORDS, token_rows: int = TOKEN_ROWS) -> DataFrame:
    """The pairs of ``jaccard_pairs``, once for each signature that they meet in.

    Where t asks for two common words or more, the signatures that meet are pairs of words
    of a key's prefix, else single words.  Candidates are checked where they meet, on word
    hashes and then on the words, so no candidate is shuffled and no words come back to a pair.
    A signature of many keys is split: its keys are cut into blocks of about ``token_rows``,
    at most ``TOKEN_BLOCKS`` of them."""
    t = float(threshold)
    tok = keys.filter("key_ord is not null").select("key_ord", F.xxhash64("tokens").alias("kid"), F.explode("tokens").alias("tok"))
    freq = tok.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # rarest first, ties by token text: a global total order on tokens
    ranked = tok.join(freq, "tok").groupBy("key_ord", "kid").agg(F.sort_array(F.collect_set(F.struct("df", "tok"))).alias("r"))
    ranked = ranked.select("key_ord", "kid", F.col("r.tok").alias("words"), F.transform("r", lambda x: F.xxhash64(x["tok"])).alias("h"), F.size("r").alias("n"))
    # a pair with ``o`` words in common has its two rarest common words among each key's first n - o + 2
    o = F.greatest(F.lit(2), F.ceil(F.lit(t) * F.col("n"))).cast("int")
    place = F.sequence(F.lit(1), F.col("n") - o + 2)
    word = lambda i: F.element_at("h", i)
    sig = lambda c, i, h: F.struct(F.lit(c).alias("c"), i.alias("pos"), h.alias("sig"))
    none = F.array().cast("array<struct<c:int,pos:int,sig:bigint>>")
    two = F.flatten(F.transform(place, lambda j: F.transform(
        F.filter(place, lambda i: i < j), lambda i: sig(2, j, F.xxhash64(word(i), word(j))))))
    one = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: sig(1, i, F.xxhash64(word(i))))
    few = (1.0 + t) / t + 1e-9  # one common word is enough for at most so many words of both keys together
    pref = ranked.select("key_ord", "kid", "n", "h", "words", F.explode(F.concat(
        F.when(F.col("n") >= 2, two).otherwise(none), F.when(F.col("n") + 1 <= few, one).otherwise(none))).alias("s"))
    pref = pref.select("key_ord", "kid", "n", "h", "words", "s.*")
    met = pref.groupBy("c", "sig").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    pref = pref.join(met, ["c", "sig"])
    # a signature's keys are cut into blocks, and each pair of blocks (p <= q) is a join key of its own
    k = F.least(F.ceil(F.col("df") / token_rows), F.lit(TOKEN_BLOCKS)).cast("int")
    own = F.pmod(F.xxhash64("key_ord"), k).cast("int")
    cols = ("key_ord", "kid", "c", "sig", "n", "pos", "h", "words")
    a = pref.select(*cols, own.alias("p"), F.explode(F.sequence(own, k - 1)).alias("q")).alias("a")
    b = pref.select(*cols, F.explode(F.sequence(F.lit(0), own)).alias("p"), own.alias("q")).alias("b")
    # length filter: |B| ≥ t·|A| and |A| ≥ t·|B|; position filter: from their first common words on
    # the two must still have enough in common
    rest = F.col("a.c") + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    enough = lambda common: common * (1.0 + t) >= F.lit(t) * (F.col("a.n") + F.col("b.n")) - 1e-9
    inter = F.array_intersect("a.words", "b.words")
    gen = F.array(*[F.lit(g) for g in generic]) if generic else F.array().cast("array<string>")
    jac = F.size(inter) / F.size(F.array_union("a.words", "b.words"))
    first = F.col("a.key_ord") < F.col("b.key_ord")
    of = lambda c: (F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")))
    (ka, kb), (wa, wb) = of("key_ord"), of("kid")
    return (a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.sig") == F.col("b.sig")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q"))
                   & ((F.col("a.p") < F.col("a.q")) | first)
                   & ((F.col("a.c") == 2) | (F.col("a.n") + F.col("b.n") <= few))
                   & (F.col("b.n") >= F.lit(t) * F.col("a.n")) & (F.col("a.n") >= F.lit(t) * F.col("b.n"))
                   & enough(rest) & enough(F.size(F.array_intersect("a.h", "b.h")))
                   & (jac >= t) & (F.size(F.array_except(inter, gen)) >= 1))
            .select(ka.alias("a"), kb.alias("b"), wa.alias("ka"), wb.alias("kb"), jac.alias("jaccard")))


def containment_pairs(keys: DataFrame, min_len: int = P.CONTAIN_MIN_LEN) -> DataFrame:
    """Key pairs (a < b by key_ord), both longer than ``min_len``, one inside the other.

    The contained key probes with its rarest (min_len + 1)-gram among the other
    keys' grams (exact: every gram of a contained key occurs in the container)."""
    from .verdicts import contained_pairs
    long_ = keys.filter(F.col("key_len") > min_len).select("key_ord", "story_key")
    hit = contained_pairs(long_, long_, "key_ord", "story_key", "key_ord", "story_key", grams=(min_len + 1,)) \
        .filter(F.col("oid") != F.col("iid"))
    return hit.select(F.least("oid", "iid").alias("a"), F.greatest("oid", "iid").alias("b")).distinct()


def similar_edges(keys: DataFrame) -> DataFrame:
    """J01 and J02 pairs, each once: a pair is shuffled once, for this."""
    return _jaccard_hits(keys).select("a", "b").unionByName(containment_pairs(keys)).distinct()


def elect_leaders(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Lexicographically first maximal independent set by key order.

    Returns ``(key_ord, leader_ord)``: a leader points to itself, an absorbed
    key to its earliest leader neighbour.  Keys without an earlier neighbour
    lead at once.  An edge is dropped once its earlier key is decided: a new
    leader's edges give its later neighbours a leader, an absorbed key's give
    nothing.  That the later key is decided changes no answer, so edges are never
    shuffled by it.  The first undecided key is decided in every round, so a round
    without progress is an error.
    """
    left, seen = measured(edges.select("a", "b"))
    led, n_left = None, seen["rows"]
    while n_left:
        # undecided keys that no undecided key precedes are leaders
        new = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        hit = written(left.join(new, "a").groupBy("b").agg(F.min("a").alias("leader_ord")))
        led = hit if led is None else led.unionByName(hit)
        left, seen = measured(left.join(new.unionByName(hit.select(F.col("b").alias("a"))), "a", "left_anti"))
        before, n_left = n_left, seen["rows"]
        if n_left >= before:
            raise RuntimeError("leader election made no progress")
    if led is None:
        return keys.select("key_ord", F.col("key_ord").alias("leader_ord"))
    lead_of = led.groupBy(F.col("b").alias("key_ord")).agg(F.min("leader_ord").alias("leader_ord"))
    return keys.select("key_ord").join(lead_of, "key_ord", "left").select(
        "key_ord", F.coalesce("leader_ord", "key_ord").alias("leader_ord"))


def ranked_items(keyed: DataFrame) -> DataFrame:
    """What W01 needs of an item: (item_id, ord, story_key, violation_count, tensions: its TENSION judgments)."""
    arr = F.coalesce(F.col("axiom_check"), F.array().cast("array<struct<axiom_id:int,judgment:string,reason:string>>"))
    return keyed.select("item_id", "ord", "story_key", "violation_count",
                        F.size(F.filter(arr, lambda x: x["judgment"] == "TENSION")).alias("tensions"))


def best_of_group(rows: DataFrame, group: str = "leader_ord") -> DataFrame:
    """Per group the row with max (violation_count, TENSION count); ties go to
    the leader's rows, then absorbed keys in key order, then input order.

    ``max_by`` is a partial aggregate, so a hot group is reduced on every
    partition before anything is shuffled.
    """
    key = F.struct(F.coalesce(F.col("violation_count"), F.lit(0)).alias("vc"), F.col("tensions").alias("tc"),
                   (-F.col("key_ord")).alias("nko"), (-F.col("ord")).alias("no"))
    return rows.groupBy(group).agg(F.max_by("item_id", key).alias("item_id"), F.count(F.lit(1)).alias("group_rows"))


def dedup_stories(items: DataFrame) -> DataFrame:
    """One surviving item per story, with its leader key order."""
    keyed = ranked_items(story_keys(items))
    keys = written(key_table(keyed))
    leaders = elect_leaders(keys, similar_edges(keys))
    # keys first: the items' rows meet one narrow table, and the winners' whole rows come back once
    led = keys.select("story_key", "key_ord").join(leaders, "key_ord")
    best = best_of_group(keyed.join(led, "story_key")).select("leader_ord", "item_id")
    return items.join(best, "item_id").select("leader_ord", *items.columns)
