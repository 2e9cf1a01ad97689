"""Records of two tables that describe the same animals, without a common key.

Method: candidates get similarity vectors (name, rarity of the name, numbers, sex), and two
regularised Gaussians, one for matches and one for the rest, are fitted to the vectors without
labels; what a vector does not tell is left out of its density. Sexes, which agree or do not, are
counted beside them. A name of two words that agrees says more than a single word that does, so that
imports with such a name have Gaussians of their own. Transitivity is enforced in every
expectation step: two records of ``animals`` are different animals, so an import row has one
animal at most, and the chances of its candidates must share one. In the last step it is enforced
on the other side too: the imports of one animal must agree with one another, but for those that
bear a number of it. The chances of the last step are the confidences.

The fit runs over all candidates: vectors are rounded, and only how often each of the (at most
some thousand) vectors occurs goes to the driver. A name or number that several animals bear
makes no pairs by itself, so that a name with a third of all rows makes none: such a class is
resolved by what comes with it, where that leaves one animal: the import's sex, a number that
the others' numbers gainsay, a number within one slip, a second name, or the name as written with
its marks (``undecided`` has the imports that nothing resolves).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.llm.golden import SEX, normalised
from kinweft.llm.variants import balls, dropped, near_pairs, readings, typed_names
from kinweft.scratch import Scratch
from kinweft.session import id_key, plain, shuffled_joins, tasks

# What the taxa are called in the sources.
TAXA = {
    "ailurus fulgens": ["ailurus fulgens", "ailurus fulgens ssp", "a. fulgens", "red panda", "lesser panda", "roter panda", "kleiner panda", "panda roux", "panda rojo", "レッサーパンダ", "ailurus"],
    "hippopotamus amphibius": ["hippopotamus amphibius", "h. amphibius", "hippopotamus", "common hippo", "hippo", "common hippopotamus", "river hippopotamus", "flusspferd", "großflusspferd", "nilpferd", "hippopotame", "hipopótamo", "カバ"],
    "choeropsis liberiensis": ["choeropsis liberiensis", "c. liberiensis", "hexaprotodon liberiensis", "pygmy hippo", "pygmy hippopotamus", "zwergflusspferd", "hippopotame pygmée", "hipopótamo pigmeo", "コビトカバ"],
    "ursus maritimus": ["ursus maritimus", "u. maritimus", "thalarctos maritimus", "polar bear", "eisbär", "ours polaire", "oso polar", "ホッキョクグマ"],
}
STUDBOOK = ["isb", "studbook", "intl-sb", "international studbook", "sb"]
CHIP = ["chip", "transponder", "microchip"]
ROUNDS = 8
ACCEPT = 0.5
#: Single words of so many letters match over two slips, shorter ones over one.
LONG_WORD = 8
FEATURES = ("name", "rare", "number", "sex", "whole")
#: What name and rare count as where a side has no name that can be read.
UNNAMED = 0.5
#: How much a studbook number with a slip agrees.
STUDBOOK_SLIP = 0.7


def taxon_key(c: Column) -> Column:
    """The taxon that c names; a name that is not known stands for itself."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.coalesce(normalised(plain, TAXA), F.nullif(plain, F.lit("")))


def numbers(rows: DataFrame) -> DataFrame:
    """(id, kind, digits): the studbook (7 digits) and chip (15, or the last 8) numbers of each record."""
    x = rows.select(id_key("id").alias("id"), F.explode("external_ids").alias("x")).where("x is not null and id is not null")
    x = x.select("id", F.lower(F.trim("x.namespace")).alias("ns"), F.regexp_replace("x.value", r"\D", "").alias("d"))
    kind = F.when(F.col("ns").isin(STUDBOOK), "studbook").when(F.col("ns").isin(CHIP), "chip")
    x = x.withColumn("kind", kind).where("kind is not null and d != ''")
    return x.select("id", "kind", F.when((F.col("kind") == "studbook") & (F.length("d") <= 7), F.lpad("d", 7, "0")).otherwise(F.col("d")).alias("digits")).distinct()


def _traits(rows: DataFrame) -> DataFrame:
    t = rows.select(id_key("id").alias("id"), taxon_key(F.col("taxon")).alias("taxon"), normalised(F.col("sex"), SEX).alias("sex")).where("id is not null")
    return t.groupBy("id").agg(F.max("taxon").alias("taxon"), F.min("sex").alias("sex_lo"), F.max("sex").alias("sex_hi"))


def _names(rows: DataFrame) -> DataFrame:
    return readings(typed_names(rows).distinct())


def _compatible(lo: Column, hi: Column, sex: Column) -> Column:
    """Whether records that state the sexes from lo to hi may be one animal of that sex."""
    return F.coalesce((lo != hi) | (lo == sex), F.lit(True))


def _classes(names: DataFrame, traits: DataFrame, by: list[str]) -> DataFrame:
    """How many animals bear a name, and the first, by the few things that may set them apart: sexes and kinds of numbers."""
    x = names.select("id", *by).distinct().join(traits.withColumnsRenamed({"has_studbook": "a_studbook", "has_chip": "a_chip"}), "id")
    return x.groupBy("taxon", *by, "a_studbook", "a_chip", "sex_lo", "sex_hi").agg(F.count("*").alias("n"), F.min("id").alias("one"))


def _resolve(classes: DataFrame, by: list[str]) -> DataFrame:
    """(import, animal, left) where the class has one animal: in all, of the import's sex, or without a number of the import's kinds.

    classes is imports joined to ``_classes``. Animals whose number is the import's are found by
    number and name. left says that the class is of the import's own name (slips, if given) and the
    animal the only one that its numbers, all of a known form, leave of it.
    """
    fits = _compatible(F.col("sex_lo"), F.col("sex_hi"), F.col("sex")) & F.col("sex").isNotNull()
    free = ~(F.col("has_studbook") & F.col("a_studbook")) & ~(F.col("has_chip") & F.col("a_chip")) & (F.col("has_studbook") | F.col("has_chip"))
    agg = []
    for name, ok in (("all", F.lit(True)), ("sex", fits), ("left", free), ("both", free & fits)):
        agg += [F.sum(F.when(ok, F.col("n"))).alias(f"n_{name}"), F.min(F.when(ok, F.col("one"))).alias(f"one_{name}")]
    own = (F.col("slips") <= 0) & F.col("formed") if "slips" in classes.columns else F.lit(False)
    x = classes.groupBy("import", *by).agg(*agg, F.max(own).alias("own"))
    one = lambda a, b: F.when(F.col(f"n_{a}") == 1, F.col(f"one_{a}")).when(F.col(f"n_{b}") == 1, F.col(f"one_{b}"))
    found = F.array(F.struct(one("all", "sex").alias("animal"), F.lit(False).alias("left")), F.struct(one("left", "both").alias("animal"), F.col("own").alias("left")))
    return x.select("import", F.explode(found).alias("f")).select("import", "f.animal", "f.left").where("animal is not null").groupBy("import", "animal").agg(F.max("left").alias("left"))


def _numbered(traits: DataFrame, nums: DataFrame) -> DataFrame:
    """traits with has_studbook and has_chip, and formed: there are numbers, and all have as many digits as their kind has."""
    formed = F.length("digits").isin(15, 8) & (F.col("kind") == "chip") | (F.length("digits") == 7) & (F.col("kind") == "studbook")
    n = nums.groupBy("id").agg(*[F.max(F.col("kind") == k).alias(f"has_{k}") for k in ("studbook", "chip")], F.min(formed).alias("formed"))
    return traits.join(n, "id", "left").fillna(False, ["has_studbook", "has_chip", "formed"])


def _keyed(n: DataFrame) -> DataFrame:
    """n with k: what numbers of one kind share that may be the same."""
    ks = dropped(F.when(F.col("kind") == "chip", F.substring("digits", -8, 8)).otherwise(F.col("digits")), 1)
    return n.withColumn("k", F.explode(ks))


def _written(rows: DataFrame) -> DataFrame:
    """(id, cls): Latin names with marks, in lower case."""
    n = typed_names(rows).withColumn("w", F.trim(F.regexp_replace(F.lower("name"), r"[\s|]+", " ")))
    return n.where(r"w rlike '^[\\x{0020}-\\x{02ff}]*[\\x{00df}-\\x{024f}][\\x{0020}-\\x{02ff}]*$'").select("id", F.concat(F.lit("written|"), "w").alias("cls")).distinct()


def _evidence(imports: DataFrame, animals: DataFrame, store: Scratch) -> dict[str, DataFrame]:
    """Traits, names and numbers of both sides, the pairs worth a look, and the imports whose name or number some animal bears."""
    iname, aname = store.write(_names(imports), "in"), store.write(_names(animals), "an")
    inum, anum = store.write(numbers(imports), "im"), store.write(numbers(animals), "am")
    whole = iname.groupBy("id").agg(F.max(~F.col("kind").isin("single", "single_pet")).alias("whole"))
    it = store.write(_numbered(_traits(imports), inum).join(whole, "id", "left").fillna(False, ["whole"]), "it")
    at = store.write(_numbered(_traits(animals), anum).drop("formed"), "at")
    isex = it.select(F.col("id").alias("import"), "taxon", F.when(F.col("sex_lo") == F.col("sex_hi"), F.col("sex_lo")).alias("sex"), "has_studbook", "has_chip", "formed", "whole")

    # A class is what a name can be found by: itself, or the letters that an initial or a pet form leaves of it.
    cls = lambda kind, given, house, ordinal: F.concat_ws("|", F.lit(kind), given, house, ordinal)
    members, near = [], []
    mine = iname.join(it.select("id", "taxon"), "id")

    full = "kind in ('full', 'open')"
    point = ["given", "house", "ordinal"]
    members.append(aname.where(full).select("id", cls("full", *point).alias("cls")))
    number = F.xxhash64("taxon", *point).alias("p")
    ip = store.write(mine.where(full).select("id", "taxon", *point, number), "ip")
    ap = store.write(aname.where(full).join(at.select("id", "taxon"), "id").select("taxon", *point, number).distinct(), "ap")
    within = ["taxon", "ordinal"]
    # Both orders of a name are readings on both sides: one side needs only the alphabetical one.
    met = near_pairs(balls(ip.select("p", "taxon", *point).distinct(), ["p"], within), balls(ap.where("given <= house"), ["p"], within))
    x = ip.select(F.col("id").alias("import"), F.col("p").alias("a"), F.col("given").alias("gi"), F.col("house").alias("hi")).join(met, "a").join(ap.withColumnRenamed("p", "b"), "b")
    x = x.withColumn("slips", F.levenshtein("gi", "given") + F.levenshtein("hi", "house")).where("slips <= 2")
    near.append(x.select("import", cls("full", *point).alias("cls"), "slips"))

    members.append(aname.where("kind = 'single'").select("id", cls("single", *point).alias("cls")))
    words = [(members[-1], mine.where("kind = 'single'").select(F.col("id").alias("import"), "taxon", "ordinal", F.lit("single").alias("as"), F.lit("").alias("head"), F.col("given").alias("word")))]

    for kind, head in (("initial", 1), ("pet", 3)):
        key = cls(kind, F.substring("given", 1, head), "house", "ordinal").alias("cls")
        members.append(aname.where(full).select("id", key))
        short = mine.where(F.col("kind") == kind).join(iname.where(full), "id", "left_anti")
        words.append((members[-1], short.select(F.col("id").alias("import"), "taxon", "ordinal", F.lit(kind).alias("as"), F.substring("given", 1, head).alias("head"), F.col("house").alias("word"))))

    # Single names, and the houses of initials and pet forms, in balls of their own radius.
    theirs = []
    for m, _ in words:
        c = F.split("cls", r"\|")
        k = m.join(at.select("id", "taxon"), "id").select("taxon", "cls").distinct()
        theirs.append(k.select("taxon", "cls", c[0].alias("as"), F.when(c[0] == "single", "").otherwise(c[1]).alias("head"), F.when(c[0] == "single", c[1]).otherwise(c[2]).alias("word"), c[3].cast("int").alias("ordinal")))
    spot = ["taxon", "as", "head", "ordinal", "word"]
    number = F.xxhash64(*spot).alias("p")
    ours_, theirs = (store.write(reduce(DataFrame.unionByName, x).withColumn("p", number), "words") for x in ([w for _, w in words], theirs))
    short = F.when(F.length("word") >= LONG_WORD - 2, dropped(F.col("word"), 2)).otherwise(dropped(F.col("word"), 1))
    ball = lambda df: df.select("p", *spot).distinct().repartition(tasks(df.sparkSession)).select("p", F.explode(F.transform(short, lambda w: F.xxhash64(w, *spot[:-1]))).alias("ball"))
    met = near_pairs(ball(ours_), ball(theirs))
    x = ours_.select("import", F.col("p").alias("a"), F.col("word").alias("wi")).join(met, "a").join(theirs.select(F.col("p").alias("b"), "cls", "word"), "b")
    near.append(x.where(F.levenshtein("wi", "word") <= _reach("wi", "word")).select("import", "cls", F.levenshtein("wi", "word").alias("slips")))

    # A name as written, where it has marks: closer than the letters alone.
    members.append(_written(animals).select("id", "cls"))
    near.append(_written(imports).select(F.col("id").alias("import"), "cls", F.lit(-1).alias("slips")))

    members = store.write(reduce(DataFrame.unionByName, members).distinct(), "members")
    near = reduce(DataFrame.unionByName, near).groupBy("import", "cls").agg(F.min("slips").alias("slips"))
    near = store.write(near.join(isex, "import"), "near")
    classes = store.write(_classes(members, at, ["cls"]), "classes")
    # Each way to a pair is written by itself: a plan of all of them, planned again after every stage, fills the driver.
    parts: list[DataFrame] = []
    way = lambda df: parts.append(store.write(df, "way"))
    way(_resolve(near.join(classes, ["taxon", "cls"]), ["cls"]))

    # Names that several animals bear, by what comes with them.
    several = classes.groupBy("taxon", "cls").agg(F.sum("n").alias("n")).where("n > 1").select("taxon", "cls")
    ours = store.write(members.join(at.select("id", "taxon"), "id").join(several, ["taxon", "cls"], "left_semi").select("id", "cls"), "ours")
    shared = store.write(near.join(several, ["taxon", "cls"], "left_semi"), "shared")
    by_number = store.write(_classes(ours.join(anum, "id"), at, ["cls", "kind", "digits"]), "by_number")
    known = _keyed(inum).select(F.col("id").alias("import"), "kind", "k", F.col("digits").alias("di"))
    # Only keys and digits multiply; what is counted of them joins the few that meet.
    keys = _keyed(by_number.select("taxon", "cls", "kind", "digits").distinct())
    x = shared.select("import", "taxon", "cls").join(known, "import").join(keys.hint("merge"), ["taxon", "cls", "kind", "k"]).where(_number_level("kind", "di", "digits") > 0)
    way(_resolve(x.select("import", "taxon", "cls", "kind", "digits").distinct().join(isex.drop("taxon"), "import").join(by_number, ["taxon", "cls", "kind", "digits"]), ["cls", "kind", "digits"]))
    two = lambda df, key: df.select(key, "cls").where("cls like 'full|%' or cls like 'single|%'").groupBy(key).agg(F.array_sort(F.collect_set("cls")).alias("cs")).withColumn("ca", F.explode("cs")).withColumn("cb", F.explode("cs")).where("ca < cb").select(key, "ca", "cb")
    way(_resolve(two(shared, "import").join(isex, "import").join(_classes(two(ours, "id"), at, ["ca", "cb"]), ["taxon", "ca", "cb"]), ["ca", "cb"]))

    # By number alone: equal, or a chip with a slip; studbook numbers run on, so that a slip in one leads
    # to dozens of animals and counts only with a name. A number that several animals of the taxon bear
    # tells none of them, unless the sex does.
    alone = store.write(_classes(anum, at, ["kind", "digits"]), "alone")
    met = known.join(_keyed(alone.select("kind", "digits").distinct()).hint("merge"), ["kind", "k"]).where(_number_level("kind", "di", "digits") > STUDBOOK_SLIP)
    x = met.select("import", "kind", "digits").distinct().join(isex, "import").join(alone, ["taxon", "kind", "digits"])
    numbered = store.write(x, "numbered")
    way(_resolve(numbered.withColumns({"has_studbook": F.lit(False), "has_chip": F.lit(False)}), ["kind", "digits"]))
    pairs = store.write(reduce(DataFrame.unionByName, parts).groupBy("import", "animal").agg(F.max("left").alias("left")), "pairs")
    # How few animals of the taxon fit an import as well: those of its classes with as few slips, an
    # animal with several names in parts.
    n_taxon = at.groupBy("taxon").agg(F.count("*").alias("n_taxon"))
    kind = F.substring_index("cls", "|", 1)
    part = members.withColumn("kind", kind).join(members.groupBy("id", kind.alias("kind")).agg(F.count("*").alias("names")), ["id", "kind"]).join(at.select("id", "taxon"), "id")
    weight = part.groupBy("taxon", "cls").agg(F.sum(1 / F.col("names")).alias("n"))
    as_near = F.sum("n").over(Window.partitionBy("import").orderBy("slips").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    fits = near.join(weight, ["taxon", "cls"]).join(n_taxon, "taxon")
    fits = fits.select("import", "cls", (1 - F.log(F.greatest(as_near, F.lit(1))) / F.log(F.greatest("n_taxon", F.lit(2)))).alias("share"))
    touched = near.join(classes, ["taxon", "cls"], "left_semi").select("import").unionByName(numbered.select("import")).distinct()
    return {"at": at, "iname": iname, "aname": aname, "inum": inum, "anum": anum, "isex": isex, "pairs": pairs, "touched": touched, "fits": fits, "members": members}


def undecided(imports: DataFrame, animals: DataFrame) -> DataFrame:
    """(import_id): imports with a name or number that animals bear, of which nothing singles one out."""
    e = _evidence(imports, animals, Scratch(imports.sparkSession, "undecided"))
    return e["touched"].join(e["pairs"], "import", "left_anti").select(F.col("import").alias("import_id"))


def candidates(imports: DataFrame, animals: DataFrame, store: Scratch) -> DataFrame:
    """(import, animal, name, rare, number, sex, whole, isex, ino): pairs worth a look, with their similarity vectors.

    name is 1 for an equal name and falls with every slip, 0 where no names agree; rare falls from
    1 with the animals that fit the import's name as well as this one, but for those that its numbers
    rule out where they leave this one; number is from -1 (numbers
    of one kind that differ) to 1 (equal ones), 0 where they say nothing; so is sex. whole is 1
    where the import has a name of more than one word.
    """
    e = _evidence(imports, animals, store)
    at, iname, aname, inum, anum, isex, pairs = (e[k] for k in ("at", "iname", "aname", "inum", "anum", "isex", "pairs"))
    isex = isex.drop("has_studbook", "has_chip", "formed")
    full = "kind in ('full', 'open')"
    point = ["given", "house", "ordinal"]

    ni = iname.where("kind != 'pet'").select(F.col("id").alias("import"), F.col("given").alias("gi"), F.col("house").alias("hi"), F.col("ordinal").alias("oi"), F.col("kind").alias("ki"))
    na = aname.where(full + " or kind = 'single'").select(F.col("id").alias("animal"), *point)
    close = 1 - 2 * (_slips("gi", "given") + _slips("hi", "house")) / (F.length("gi") + F.length("hi") + F.length("given") + F.length("house"))
    letter = (F.col("ki") == "initial") & (F.levenshtein("hi", "house") <= _reach("hi", "house")) & F.expr("startswith(given, gi)")
    alike = F.when(F.col("oi") != F.col("ordinal"), 0.0).when(letter, 0.9).when((F.col("hi") == "") != (F.col("house") == ""), 0.0).otherwise(F.greatest(close, F.lit(0.0)))
    named = pairs.join(ni, "import").join(na, "animal").groupBy("import", "animal").agg(F.max(alike).alias("name"))
    pet = iname.where("kind = 'pet'").select(F.col("id").alias("import"), F.col("given").alias("stem"), F.col("house").alias("hp"))
    stems = pairs.join(pet, "import").join(na, "animal").where((F.levenshtein("hp", "house") <= _reach("hp", "house")) & F.expr("startswith(given, stem)")).select("import", "animal").distinct().withColumn("by_stem", F.lit(0.9))
    rare = pairs.join(e["fits"], "import").join(e["members"].withColumnRenamed("id", "animal"), ["animal", "cls"]).groupBy("import", "animal").agg(F.min("share").alias("share"))
    nx = inum.select(F.col("id").alias("import"), "kind", F.col("digits").alias("di"))
    ny = anum.select(F.col("id").alias("animal"), "kind", F.col("digits").alias("da"))
    number = pairs.join(nx, "import").join(ny, ["animal", "kind"]).groupBy("import", "animal").agg(F.max(_number_level("kind", "di", "da")).alias("hit"))
    number = number.select("import", "animal", F.when(F.col("hit") > 0, F.col("hit")).otherwise(F.lit(-1.0)).alias("number"))
    asex = at.select(F.col("id").alias("animal"), "sex_lo", "sex_hi")
    sex = F.when(F.col("sex").isNull() | F.col("sex_lo").isNull(), 0.0).when(_compatible(F.col("sex_lo"), F.col("sex_hi"), F.col("sex")), 1.0).otherwise(-1.0)
    # Written one by one, as the ways to a pair are.
    named, stems, rare, number = (store.write(df, label) for df, label in ((named, "named"), (stems, "stems"), (rare, "rare"), (number, "number")))
    out = pairs.join(named, ["import", "animal"], "left").join(stems, ["import", "animal"], "left").join(rare, ["import", "animal"], "left").join(number, ["import", "animal"], "left").join(isex, "import").join(asex, "animal")
    out = out.join(inum.where("kind = 'studbook'").groupBy(F.col("id").alias("import")).agg(F.min("digits").alias("ino")), "import", "left")
    step = lambda c: F.round(c * 20) / 20
    return out.select(
        "import", "animal", step(F.coalesce(F.greatest("name", "by_stem"), F.lit(UNNAMED))).alias("name"), step(F.when(F.col("left"), 1.0).otherwise(F.coalesce("share", F.lit(UNNAMED)))).alias("rare"),
        F.coalesce("number", F.lit(0.0)).alias("number"), sex.alias("sex"), F.col("whole").cast("double").alias("whole"), F.col("sex").alias("isex"), "ino",
    )


def _number_level(kind: str, a: str, b: str) -> Column:
    """1 for equal numbers, 0.9 for the last eight digits of a chip, 0.8 for these and 0.7 for a studbook number with a slip, else 0."""
    x, y = F.col(a), F.col(b)
    chip, tx, ty = F.col(kind) == "chip", F.substring(x, -8, 8), F.substring(y, -8, 8)
    short = F.least(F.length(x), F.length(y)) == 8
    near = lambda p, q: _off(p, q) <= 1
    slip = F.when(chip, (F.length(x) >= 8) & (F.length(y) >= 8) & F.when(short, near(tx, ty)).otherwise(near(x, y)))
    return F.when(x == y, 1.0).when(chip & short & (tx == ty), 0.9).when(slip, 0.8).when(~chip & near(x, y), STUDBOOK_SLIP).otherwise(0.0)


def _off(x: Column, y: Column) -> Column:
    """The edit distance of two texts, two neighbours in the wrong order counting once."""
    d = F.levenshtein(x, y)
    return F.when((d == 2) & (F.length(x) == F.length(y)) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))), 1).otherwise(d)


def _slips(a: str, b: str) -> Column:
    return _off(F.col(a), F.col(b))


def _reach(a: str, b: str) -> Column:
    """How many slips two single words of one animal may be apart."""
    return F.when(F.least(F.length(a), F.length(b)) >= LONG_WORD, 2).otherwise(1)


class Mixture:
    """Two Gaussians over vectors with weights, their covariances regularised.

    Each covariance is drawn towards the pooled one (tie), its diagonal (shrink) and a ridge. What a
    vector does not tell (nan) is left out of the means and of its density, so that it speaks neither
    for nor against. said is what else a vector says, as 1 (yes), -1 (no) or 0 (nothing); how often
    each is said is counted on both sides.
    """

    def __init__(self, x: np.ndarray, tie: float = 0.8, shrink: float = 0.5, ridge: float = 0.02, said: np.ndarray | None = None):
        self.seen, self.x, self.tie, self.shrink, self.ridge = ~np.isnan(x), np.nan_to_num(x), tie, shrink, ridge
        self.said = np.zeros(len(x)) if said is None else said

    def maximise(self, n: np.ndarray, matched: np.ndarray) -> None:
        """n: how often each vector occurs; matched: how much of it counts as matched."""
        self.share = float(np.clip(matched.sum() / max(n.sum(), 1e-9), 1e-3, 1 - 1e-3))
        means, covs, sizes = [], [], []
        for w in (matched, np.maximum(n - matched, 0.0)):
            mean = (w[:, None] * self.seen * self.x).sum(0) / np.maximum((w[:, None] * self.seen).sum(0), 1e-9)
            d = (self.x - mean) * self.seen
            both = np.einsum("i,ij,ik->jk", w, self.seen.astype(float), self.seen.astype(float))
            means.append(mean)
            covs.append(np.einsum("i,ij,ik->jk", w, d, d) / np.maximum(both, 1e-9))
            sizes.append(max(w.sum(), 1e-9))
        self.says = np.zeros(len(n))
        for w, sign in ((matched, 1), (np.maximum(n - matched, 0.0), -1)):
            for v in (1, -1):
                self.says[self.said == v] += sign * np.log((w[self.said == v].sum() + 1) / (w[self.said != 0].sum() + 2))
        pooled = (covs[0] * sizes[0] + covs[1] * sizes[1]) / sum(sizes)
        self.parts = []
        for mean, cov in zip(means, covs):
            cov = (1 - self.tie) * cov + self.tie * pooled
            self.parts.append((mean, (1 - self.shrink) * cov + self.shrink * np.diag(np.diag(cov)) + self.ridge * np.eye(len(mean))))

    def odds(self) -> np.ndarray:
        """The odds of a match for each vector."""
        logs = np.log(self.share / (1 - self.share)) + self.says
        for pattern in np.unique(self.seen, axis=0):
            at, k = (self.seen == pattern).all(1), np.flatnonzero(pattern)
            for sign, (mean, cov) in zip((1, -1), self.parts):
                d, c = self.x[np.ix_(at, k)] - mean[k], cov[np.ix_(k, k)]
                logs[at] -= sign * 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
        return np.exp(np.clip(logs, -20, 20))


def matches(imports: DataFrame, animals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(import_id, animal_id, confidence): for each import row its likeliest animal, if over ``ACCEPT``.

    Records of one id are one record on either side. Taxa must be the same animal's; sexes and
    numbers may be missing or wrong. Null ids are no records; null and unreadable fields say
    nothing for or against. Ties go to the smaller animal id. Without candidates there are no
    rows. Extra columns are ignored.
    """
    with shuffled_joins(imports.sparkSession):
        return _matches(imports, animals, rounds)


def _matches(imports: DataFrame, animals: DataFrame, rounds: int) -> DataFrame:
    spark = imports.sparkSession
    store = Scratch(spark, "matching")
    cols = ("id", "taxon", "sex", "name", "aliases", "external_ids")
    found = store.write(candidates(imports.select(*cols), animals.select(*cols), store), "vectors")
    counted = sorted((tuple(r[f] for f in FEATURES), r["n"]) for r in found.groupBy(*FEATURES).agg(F.count("*").alias("n")).collect())
    if not counted:
        return found.select(F.col("import").alias("import_id"), F.col("animal").alias("animal_id"), F.lit(0.0).alias("confidence"))
    values, n = np.array([v for v, _ in counted], float), np.array([c for _, c in counted], float)
    whole, x = values[:, 4] == 1, values[:, :3].copy()
    x[:, 2][values[:, 2] == 0] = np.nan
    # Single words by themselves hardly part, so that their mixture is fitted over all.
    models = [(of, use, Mixture(x[of], said=values[of, 3])) for of, use in ((np.full(len(n), True), ~whole), (whole, whole)) if use.any()]
    table = spark.createDataFrame([(*v, k) for k, (v, _) in enumerate(counted)], ", ".join(f"{f} double" for f in FEATURES) + ", v int")
    # The candidates of an import lie together from here on: a round reads them where they are.
    own = found.join(table, list(FEATURES)).groupBy("import").agg(F.collect_list(F.struct("animal", "v", "isex", "ino")).alias("c"))
    own = store.write(own, "own")
    start = 1 / (1 + np.exp(-8 * (x[:, 0] - 0.85) - 6 * (x[:, 1] - 0.6) - 3 * values[:, 2] - values[:, 3]))
    odds = start / (1 - start)
    for _ in range(rounds):
        got = own.select("c.v").mapInPandas(_expected(odds), "v int, m double").groupBy("v").agg(F.sum("m").alias("m")).collect()
        matched = np.zeros(len(n))
        for r in got:
            matched[r["v"]] = r["m"]
        for of, use, model in models:
            model.maximise(n[of], matched[of])
            odds[use] = model.odds()[use[of]]
    # The last expectation holds on both sides: the imports of an animal must be one animal too.
    p = own.select("import", "c").mapInPandas(_shares(odds, values[:, 2] > 0), "import string, animal string, isex string, ino string, p double, numbered boolean")
    p = store.write(p.where("p > 0.01"), "shares")
    tie = F.struct(F.col("p"), F.struct(F.expr("-cast(conv(substr(sha1(animal), 1, 8), 16, 10) as bigint)").alias("tie")))
    best = _agreed(p).groupBy("import").agg(F.max_by(F.struct("animal", "p"), tie).alias("b"))
    best = best.where(F.col("b.p") > ACCEPT).select(F.col("import").alias("import_id"), F.col("b.animal").alias("animal_id"), F.round("b.p", 6).alias("confidence"))
    return store.write(best, "matches")


def _agreed(p: DataFrame) -> DataFrame:
    """p lowered where a likelier import of the animal says something else: of two imports that state
    different sexes, or numbers more than a slip apart, not both can be the animal. An import with a
    number of the animal's stands: what speaks against it may as well be the slip."""
    for said in ("isex", "ino"):
        stated = p.where(F.col(said).isNotNull()).groupBy("animal", said).agg(F.max("p").alias("most"))
        first = stated.groupBy("animal").agg(F.max_by(F.struct(F.col(said).alias("said"), "most"), F.struct("most", said)).alias("f"))
        other = F.col("f.said").isNotNull() & (F.col("f.said") != F.col(said)) & (F.col("f.most") > F.col("p")) & ~F.col("numbered")
        if said == "ino":
            other = other & (_off(F.col("f.said"), F.col(said)) > 1)
        p = p.join(first, "animal", "left").withColumn("p", F.when(other, F.col("p") * (1 - F.col("f.most"))).otherwise(F.col("p"))).drop("f")
    return p


def _sums(batch: pd.DataFrame, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a batch's candidates, how many each import has, and their chances, with none among them."""
    sizes = np.array([len(v) for v in batch], np.int64)
    at = np.concatenate([np.asarray(v, np.int64) for v in batch]) if len(sizes) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return at, sizes, odds[at] / (1 + np.bincount(row, odds[at], len(sizes))[row])


def _expected(odds: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(odds))
        for b in batches:
            at, _, p = _sums(b["v"], odds)
            total += np.bincount(at, p, len(odds))
        k = np.flatnonzero(total)
        yield pd.DataFrame({"v": k.astype("int32"), "m": total[k]})

    return run


def _shares(odds: np.ndarray, numbered: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, sizes, p = _sums(b["c"].map(lambda cs: [c["v"] for c in cs]), odds)
            rows = [c for cs in b["c"] for c in cs]
            yield plain(pd.DataFrame({"import": np.repeat(b["import"].to_numpy(object), sizes), **{f: [c[f] for c in rows] for f in ("animal", "isex", "ino")}, "p": p, "numbered": numbered[at]}))

    return run
