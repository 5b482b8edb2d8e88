"""Free-entered values mapped to a canonical list by a pigeonhole join, in SQL expressions only.

A reference string is cut into k+1 segments. Within k edits of it a value has to hold at
least one segment unchanged, shifted by no more than k; so segments are joined by
equality on positional substrings, and only those pairs are verified with levenshtein.
What finds no entry is reported through an anti-join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credograph.llm.splits import PLACEHOLDERS
from credograph.session import cut

MAX_EDITS = 2
#: Letters a name needs for one and for two slips; shorter ones are codes and have to be exact.
LETTERS_FOR_ONE, LETTERS_FOR_TWO = 6, 7
GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()))
#: Those that tell one entity of a series from the next at the end of a key; shorter ones end too many names.
SUFFIXES = "|".join(g for g in GREEK.values() if len(g) >= 4)
#: Salts and hydrates, formulations and routes: added to a compound's name they don't change what it means.
SALTS = "acetate benzoate besylate bromide calcium chloride citrate dihydrate dihydrochloride fumarate gluconate hcl hemihydrate hydrate hydrobromide hydrochloride lactate magnesium malate maleate mesilate mesylate monohydrate nitrate oxalate pamoate phosphate potassium sodium succinate sulfate sulphate tartrate tosilate tosylate trihydrate".split()
FORMS = "capsule capsules cream delayed release extended release controlled release modified release sustained release immediate release drops gel generic high dose infusion inhaled injection intramuscular intravenous iv liposomal low dose lozenge nasal ointment ophthalmic oral patch powder solution spray subcutaneous suppository suspension syrup tablet tablets topical transdermal"
ADDITIONS = SALTS + re.findall(r"\w+ (?:release|dose)\b|\w+", FORMS)
#: General words that may follow the name of a target.
TARGET_ADDITIONS = ["protein", "pathway", "receptor complex", "signaling", "signalling", "gene", "gene product"]
#: So many reference names at most are broadcast, as segments; with more the join is shuffled.
BROADCAST_NAMES = 100_000
DOSE = r"\b\d[\d.,]*(?:\s*/\s*\d[\d.,]*)?\s*(?:mg|mcg|µg|g|ml|iu)\b(?:\s*/\s*(?:kg|day|m2|d|ml))?(?:\s+(?:bid|qd|tid|daily))?"


def plain(c: Column, kind: Column) -> Column:
    """Lower case, Greek letters by name, without remarks in brackets; of compounds also without doses, salts and formulations."""
    v = F.lower(c)
    for sign, name in GREEK.items():
        v = F.replace(v, F.lit(sign), F.lit(name))
    v = F.regexp_replace(v, r"\s*[(\[][^)\]]*[)\]]", " ")
    drug = F.regexp_replace(F.regexp_replace(v, DOSE, " "), rf"\b(?:{'|'.join(ADDITIONS)})\b", " ")
    return F.when(kind == "target", v).otherwise(drug)


def key(v: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(v, r"[^\p{L}\p{Nd}]", "")


def series(k: Column) -> Column:
    """All digits and the Greek letter at the end: what tells one entity of a series from the next."""
    return F.concat(F.regexp_replace(k, r"\P{Nd}", ""), F.lit("/"), F.regexp_extract(k, f"({SUFFIXES})$", 1))


def edits(k: Column) -> Column:
    """Slips allowed in a key, by the letters of its name."""
    letters = F.length(F.regexp_replace(F.regexp_replace(k, r"\p{Nd}", ""), f"({SUFFIXES})$", ""))
    return F.when(letters >= LETTERS_FOR_TWO, MAX_EDITS).when(letters >= LETTERS_FOR_ONE, 1).otherwise(0)


def reference_keys(entities: DataFrame) -> DataFrame:
    """``kind, name_key, entity_id`` of canonical names and synonyms; a key of several entities goes to the smallest."""
    names = entities.select("entity_id", F.col("entity_type").alias("kind"), F.explode(F.array_union(F.array("canonical_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    return names.select("kind", key(plain(F.col("name"), F.col("kind"))).alias("name_key"), "entity_id").where("name_key <> ''").groupBy("kind", "name_key").agg(F.min("entity_id").alias("entity_id"))


def _segment_start(length: Column, i: int, parts: int) -> Column:
    """Where segment i of a string of this length begins, from 0."""
    return F.floor(length * i / parts).cast("int")


def match(values: DataFrame, entities: DataFrame, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """``kind, value, entity_id`` of each distinct value; 0 where it means no entry.

    ``values`` has ``kind`` and ``value``. Exact keys are joined first; the others by
    segments, verified within the slips their length allows and with the same digits and
    Greek letter. The closest entry wins, then the smallest id. Null and blank values and
    placeholders give no row. Only distinct values take part, so a value typed in a third
    of the rows is matched once.
    """
    refs = cut(reference_keys(entities))
    v = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    distinct = values.where((v != "") & ~F.lower(v).isin(PLACEHOLDERS)).select("kind", "value").distinct()
    lean = plain(F.col("value"), F.col("kind"))
    # a general word after a target's name is dropped unless the whole is a name itself
    short = key(F.regexp_replace(lean, rf"\s(?:{'|'.join(TARGET_ADDITIONS)})\s*$", ""))
    keys = F.array_distinct(F.array(key(lean), F.when(F.col("kind") == "target", short).otherwise(key(lean))))
    keyed = cut(distinct.select("kind", "value", keys.alias("keys")))
    exact = cut(keyed.select("kind", "value", F.explode("keys").alias("name_key")).join(refs, ["kind", "name_key"]).groupBy("kind", "value").agg(F.min("entity_id").alias("entity_id")))
    rest = keyed.join(exact.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", F.explode("keys").alias("k")).where(edits(F.col("k")) > 0)
    parts = MAX_EDITS + 1
    n, m = F.length("name_key"), F.length("k")
    segments = refs.where(edits(F.col("name_key")) > 0).select("kind", "name_key", "entity_id", n.alias("n"), F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.substring(F.col("name_key"), _segment_start(n, i, parts) + 1, _segment_start(n, i + 1, parts) - _segment_start(n, i, parts)).alias("segment")) for i in range(parts)])).alias("s")).select("kind", "name_key", "entity_id", "n", "s.*")
    if refs.count() <= broadcast_names:
        segments = F.broadcast(segments)
    # verification is the work: distinct keys are spread over all cores, by number, which adaptive coalescing leaves alone
    probes = rest.select("kind", "k").distinct().repartition(4 * rest.sparkSession.sparkContext.defaultParallelism, "kind", "k")
    probes = probes.select("kind", "k", F.explode(F.sequence(m - MAX_EDITS, m + MAX_EDITS)).alias("n")).where("n >= 3")
    size = F.col("n")
    probe = [F.struct(F.lit(i).alias("part"), F.substring(F.col("k"), _segment_start(size, i, parts) + 1 + d, _segment_start(size, i + 1, parts) - _segment_start(size, i, parts)).alias("segment"), (_segment_start(size, i, parts) + d).alias("at")) for i in range(parts) for d in range(-MAX_EDITS, MAX_EDITS + 1)]
    probes = probes.select("kind", "k", "n", F.explode(F.filter(F.array(*probe), lambda s: s["at"] >= 0)).alias("s")).select("kind", "k", "n", "s.part", "s.segment")
    pairs = probes.join(segments, ["kind", "n", "part", "segment"])
    far = F.levenshtein(F.col("k"), F.col("name_key"), MAX_EDITS)
    greek = F.regexp_extract(F.col("k"), f"({SUFFIXES})$", 1)
    same = F.when(greek == "", F.regexp_replace("k", r"\P{Nd}", "") == F.regexp_replace("name_key", r"\P{Nd}", "")).otherwise(series(F.col("k")) == series(F.col("name_key")))
    close = pairs.where(same).withColumn("far", far).where((F.col("far") >= 0) & (F.col("far") <= F.least(edits(F.col("k")), edits(F.col("name_key")))))
    close = close.groupBy("kind", "k").agg(F.min(F.struct("far", "entity_id")).alias("best"))
    fuzzy = rest.join(close, ["kind", "k"]).groupBy("kind", "value").agg(F.min("best")["entity_id"].alias("entity_id"))
    found = cut(exact.unionByName(fuzzy))
    unmatched = keyed.join(found, ["kind", "value"], "left_anti").select("kind", "value", F.lit(0).cast("long").alias("entity_id"))
    return found.unionByName(unmatched)
