"""Variant spellings of organisation and person names linked to one entity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm import letters
from folioscope.llm.similar import near_pairs
from folioscope.runtime import cut

#: Lines of business as written in names, by language, with their usual abbreviations.
LINES = {
    "food": "foods food fds fd alimentation alim 食品", "chemistry": "chemical chemicals chem chimie chim 化学", "electric": "electric electrical elec electricite 電機 電気",
    "printing": "printing prtg ptg imprimerie impr imp 印刷", "logistics": "logistics logis logist logistique log 物流 運輸", "shipping": "marine mar transports-maritimes transp-mar transp transports maritimes 海運",
    "trading": "trading trdg trad negoce neg 商事 貿易", "building": "construction constr const batiment bat 建設", "packaging": "packaging pkg emballage emb 包装", "instruments": "instruments instrument instr mesures mes 計器",
    "precision": "precision prec 精機 精密", "making": "manufacturing mfg metallerie met 製作所",
}
#: Legal forms, courtesy words and departments; they don't tell one name from another.
FORMS = set(
    "co ltd limited company inc incorporated corp corporation llc kk kabushiki kaisha sas sarl sa societe anonyme liability the and et sons fils mx mr mrs ms mme mlle dr gmbh plc yk".split()
) | {"株式会社", "有限会社", "合同会社", "御中", "様", "殿"}
_DEPARTMENT = re.compile(r"[\s　]*(?:経理部|購買課|購買部|総務部|営業部|製造部|人事部|資材部|[^\s]{1,3}(?:支店|支社|営業所|事業部)|御中|様)$")
#: Given names and their short forms.
GIVEN = {
    "patricia": "pat trish tricia patty", "victoria": "vicky vic tori", "susan": "sue susie", "margaret": "peggy meg maggie marge", "frederick": "fred fritz freddy", "edward": "ed ted eddie ned",
    "theodora": "dora thea ted theo", "deborah": "deb debbie", "isabella": "bella izzy isa", "william": "bill will billy", "michael": "mike mick", "thomas": "tom tommy", "alexander": "alex sasha xander",
    "elizabeth": "liz beth betty eliza", "richard": "rick dick rich", "andrew": "drew andy", "robert": "bob rob bobby", "charles": "chuck charlie", "katherine": "kate kathy katie", "jennifer": "jen jenny",
    "samuel": "sam sammy", "anthony": "tony", "james": "jim jimmy jamie", "nicholas": "nick nico", "joseph": "joe joey", "daniel": "dan danny", "benjamin": "ben", "christopher": "chris", "catherine": "cathy", "barbara": "barb",
    "steven": "steve", "gregory": "greg", "rebecca": "becky", "dorothy": "dot dottie", "philip": "phil", "lawrence": "larry", "matthew": "matt", "timothy": "tim", "kenneth": "ken", "pamela": "pam",
}


@cache
def _line_of() -> dict[str, str]:
    return {w: line for line, words in LINES.items() for w in words.split()}


@cache
def _given_of() -> dict[str, str]:
    table: dict[str, set[str]] = {}
    for full, short in GIVEN.items():
        for w in [full, *short.split()]:
            table.setdefault(w, set()).add(full)
    return {w: "|".join(sorted(f)) for w, f in table.items()}


def _given(word: str) -> str:
    """Full given names a word may stand for; one typing error is forgiven in longer words."""
    table = _given_of()
    if word in table:
        return table[word]
    if len(word) >= 5:
        near = [f for f in GIVEN if abs(len(f) - len(word)) < 2 and letters.distance(word, f, 1) <= 1]
        return "|".join(near)
    return ""


def parse_name(company: str) -> tuple[str, str, str, list[str]] | None:
    """(kind, core, attribute, words) of a name: ``org`` with its line of business, ``person`` with given names or an initial; the core in one piece and as words."""
    text = letters.plain(company)
    text = re.sub(r"\(\s*株\s*\)|\(\s*有\s*\)", " ", text)
    if any(letters.is_kanji(c) or letters.is_kana(c) for c in text):
        for _ in range(2):
            text = _DEPARTMENT.sub("", text.strip())
        for form in ("株式会社", "有限会社", "合同会社"):
            text = text.replace(form, " ")
        text = re.sub(r"k\.?\s?k\.?", " ", text)
        text = re.sub(r"\bco\b\.?|\bltd\b\.?|\binc\b\.?|[\s・ー.,\-&()]", "", text)
        line = next((w for w in sorted(_line_of(), key=len, reverse=True) if not w.isascii() and text.endswith(w) and len(text) > len(w)), "")
        core = letters.romaji(text[: len(text) - len(line)])
        return ("org", core, _line_of().get(line, ""), [core]) if core else None
    comma = "," in text
    text = re.sub(r"\b((?:[a-z]\.\s?){2,})", lambda m: re.sub(r"[.\s]", "", m.group(1)) + " ", text)
    text = re.sub(r"\bco\.?\s*,\s*ltd\b\.?|\bco\.\s*|\bltd\.?", " ", text).replace("'", "")
    mx = bool(re.match(r"\s*mx\b", text))
    parts = [re.findall(r"[^\W_]+", p) for p in text.split(",")]
    line, legal = "", False
    kept: list[list[str]] = []
    for p in parts:
        words = []
        for w in p:
            if w in FORMS:
                legal |= w not in ("the", "and", "et", "mx", "mr", "mrs", "ms", "mme", "mlle", "dr")
            elif w in _line_of() and not (line and _line_of()[w] != line):
                line = _line_of()[w]
            else:
                words.append(w)
        kept.append(words)
    kept = [p for p in kept if p]
    if not kept:
        return ("org", letters.romaji("".join(w for p in parts for w in p)), line, [w for p in parts for w in p]) if any(parts) else None
    if not line and not legal:
        flat = [w for p in kept for w in p]
        if comma and len(kept) == 2 and kept[1]:
            first, rest, initials = kept[1][0], kept[0], len(kept[1][0]) == 1
        else:
            first, rest, initials = flat[0], flat[1:], len(flat[0]) == 1
        name = _given(first)
        if rest and (name or initials or mx):
            surname = "".join(w for w in rest if len(w) > 1)
            if surname:
                return ("person", surname, name or first, [w for w in rest if len(w) > 1])
    if len(kept) >= 2 and comma:
        kept = [kept[1], kept[0], *kept[2:]]
    words = [w for p in kept for w in p if len(w) > 1] or [w for p in kept for w in p]
    return "org", "".join(words), line, words


def parse_names(parties: DataFrame) -> DataFrame:
    """``(ids, least, kind, core, attribute, words, kana)`` of every distinct usable name: the records that bear it, their smallest id, and its parts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("core", pa.string()), ("attribute", pa.string()), ("words", pa.list_(pa.string())), ("kana", pa.string())])
        for b in batches:
            at, out = [], []
            for i, company in enumerate(b.column(0).to_pylist()):
                name = parse_name(company)
                if name:
                    at.append(i)
                    out.append((*name, letters.kana_of(name[1]) if name[0] == "org" else ""))
            parts = [pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)]
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2), *parts], ["ids", "least", *schema.names])

    p = parties.where("party_id IS NOT NULL AND company IS NOT NULL").select(F.col("party_id").cast("bigint"), "company")
    p = p.groupBy("company").agg(F.collect_set("party_id").alias("ids"), F.min("party_id").alias("least"))
    return p.mapInArrow(parse, "ids array<bigint>, least bigint, kind string, core string, attribute string, words array<string>, kana string")


#: Soft weighted similarity of the tokens from which two names are one, and from which a pair is weighed at all.
ALIKE, WEIGHED = 0.75, 0.5


def _token_likeness(x: Column, y: Column) -> Column:
    """How far one word may stand for another: equal, one edit apart, a short form (same first letter, its letters in their order), or an initial."""
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    in_order = F.rlike(long, F.concat(F.lit("^"), F.array_join(F.filter(F.split(short, ""), lambda c: c != ""), ".*")))
    same_start = F.substr(x, F.lit(1), F.lit(1)) == F.substr(y, F.lit(1), F.lit(1))
    return (
        F.when(x == y, 1.0)
        .when(~same_start, F.when((F.length(short) >= 5) & (F.levenshtein(x, y) <= 1), 0.9).otherwise(0.0))
        .when(F.length(short) == 1, 0.5)
        .when(((F.length(short) >= 5) & (F.levenshtein(x, y) <= 1)) | ((F.length(short) >= 3) & in_order), 0.9)
        .otherwise(0.0)
    )


def similar_words(names: DataFrame) -> DataFrame:
    """``(kind_a, a, kind_b, b, soft)`` for ordered pairs of distinct cores with ``words`` in common, in any order.

    Words weigh the more the rarer they are among the distinct names. Prefix filter: the words of a
    name are ordered by rarity, and of those only as many are joined as leave less than a third of the
    name's weight, because a pair that shares none of them cannot reach the similarity. ``soft`` is the
    weight of the words that have a counterpart, times how alike the two are, over all weight of both
    names; pairs below WEIGHED are not returned. Words that all differ are left to the join of whole cores.
    """
    bags = names.select("kind", "core", F.array_sort(F.array_distinct("words")).alias("bag")).where(F.size("bag") > 0).groupBy("kind", "core").agg(F.min("bag").alias("bag"))
    each = bags.select("kind", "core", F.explode("bag").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("n"))
    total = bags.agg(F.count("*").alias("total"))
    weighed = each.join(rarity, "word").join(F.broadcast(total)).withColumn("weight", F.log(1 + F.col("total") / F.col("n")))
    full = weighed.groupBy("kind", "core").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("bag"), F.sum("weight").alias("sum"))
    full = cut(full.withColumn("ranked", F.array_sort(F.transform("bag", lambda x: F.struct((-x["weight"]).alias("r"), x["word"].alias("word"))))))
    before = F.transform("ranked", lambda x, i: F.struct(x["word"].alias("word"), F.aggregate(F.slice("ranked", 1, i), F.lit(0.0), lambda s, y: s - y["r"]).alias("before")))
    keys = full.select("kind", "core", "bag", "sum", F.explode(F.filter(before, lambda x: x["before"] <= F.col("sum") * 2 / 3)).alias("k")).select("kind", "core", "bag", "sum", "k.word")
    a = keys.select("word", *(F.col(c).alias(f"{c}_a") for c in ("kind", "core", "bag", "sum")))
    b = keys.select("word", *(F.col(c).alias(f"{c}_b") for c in ("kind", "core", "bag", "sum")))
    # One side's weight is at most so much of the other's when the similarity is reached.
    pairs = a.join(b, "word").where("core_a < core_b AND least(sum_a, sum_b) * 3 >= greatest(sum_a, sum_b)")
    pairs = pairs.groupBy("kind_a", "core_a", "kind_b", "core_b").agg(*(F.first(c).alias(c) for c in ("bag_a", "bag_b", "sum_a", "sum_b")))
    matched = lambda x, y: F.aggregate(x, F.lit(0.0), lambda s, u: s + u["weight"] * F.array_max(F.transform(y, lambda v: _token_likeness(u["word"], v["word"]))))
    soft = (matched(F.col("bag_a"), F.col("bag_b")) + matched(F.col("bag_b"), F.col("bag_a"))) / (F.col("sum_a") + F.col("sum_b"))
    found = pairs.withColumn("soft", soft).where(F.col("soft") >= WEIGHED).select("kind_a", F.col("core_a").alias("a"), "kind_b", F.col("core_b").alias("b"), "soft")
    return found.unionByName(found.select(F.col("kind_b").alias("kind_a"), F.col("b").alias("a"), F.col("kind_a").alias("kind_b"), F.col("a").alias("b"), "soft"))


def link_names(parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(party_id, class_id)`` of the classes of equal names, and links ``(class_a, class_b, score)`` between them.

    Names are parsed into a core (the name proper, as letters; katakana in romaji) and an attribute
    (line of business or given name). Distinct names are parsed once, distinct cores joined where few edits
    apart, and on their rarest words. Verification is a soft weighted token similarity: core and attribute weigh
    the more the rarer they are among the distinct names, cores count by edit or word similarity, a
    missing attribute by half, an initial by three quarters, contradicting ones (another line of business, another given name)
    forbid the link. A name without a line of business joins one only where its core stands in one
    line alone.
    """
    named = cut(parse_names(parties))
    classes = cut(named.groupBy("kind", "core", "attribute").agg(F.min("least").alias("class_id"), F.min("words").alias("words"), F.min("kana").alias("kana")))
    members = named.join(classes.select("kind", "core", "attribute", "class_id"), ["kind", "core", "attribute"]).select(F.explode("ids").alias("party_id"), "class_id")
    near = near_pairs(classes.select(F.col("kind").alias("scope"), F.col("core").alias("text"), "kana"))
    edited = near.withColumn("soft", 1 - F.col("distance") / F.greatest(F.length("a"), F.length("b")))
    same = classes.select(F.col("kind").alias("scope"), F.col("core").alias("a"), F.col("core").alias("b"), F.lit(0).alias("distance"), F.lit(1.0).alias("soft"))
    worded = cut(similar_words(classes))
    by_words = worded.where("kind_a = kind_b").select(F.col("kind_a").alias("scope"), "a", "b", F.lit(2).alias("distance"), "soft")
    near = cut(edited.unionByName(same).unionByName(by_words).groupBy("scope", "a", "b").agg(F.min("distance").alias("distance"), F.max("soft").alias("soft")))
    total = classes.select(F.count("*").alias("total"))
    rarity = lambda *by: classes.groupBy(*by).agg(F.count("*").alias("k")).join(F.broadcast(total)).select(*by, F.log(1 + F.col("total") / F.col("k")).alias("weight"))
    core_weight, attribute_weight = rarity("kind", "core"), rarity("kind", "attribute")
    weighed = classes.join(core_weight, ["kind", "core"]).withColumnRenamed("weight", "core_weight").join(attribute_weight, ["kind", "attribute"])
    side = lambda x: weighed.select(F.col("kind").alias("scope"), F.col("core").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("attribute", "class_id", "core_weight", "weight")))
    # How many lines of business stand by a core and its near spellings.
    lines = (
        near.where("scope = 'org' AND soft >= 0.75").join(side("b").where("attribute_b <> ''"), ["scope", "b"])
        .groupBy("scope", "a").agg(F.count_distinct("attribute_b").alias("lines"))
    )
    pairs = near.join(side("a"), ["scope", "a"]).join(side("b"), ["scope", "b"]).where("class_id_a < class_id_b")
    one_line = lines.where("lines = 1").select("scope", F.col("a").alias("core"), F.lit(True).alias("single"))
    missing = F.when(F.col("attribute_a") == "", F.col("a")).when(F.col("attribute_b") == "", F.col("b"))
    pairs = pairs.withColumn("core", missing).join(one_line, ["scope", "core"], "left")
    a, b = F.col("attribute_a"), F.col("attribute_b")
    org = F.col("scope") == "org"
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    given = F.when(initial, F.exists(F.split(a, r"\|"), lambda x: F.exists(F.split(b, r"\|"), lambda y: F.substr(x, F.lit(1), F.lit(1)) == F.substr(y, F.lit(1), F.lit(1))))).otherwise(
        F.arrays_overlap(F.split(a, r"\|"), F.split(b, r"\|"))
    )
    alike = F.when(a == b, 1.0).when(org & ((a == "") | (b == "")), F.when(F.col("single"), 0.5)).when(~org & given, F.when(initial, 0.75).otherwise(1.0))
    core, attribute = F.least("core_weight_a", "core_weight_b"), F.least("weight_a", "weight_b")
    score = (core * F.col("soft") + attribute * alike) / (core + attribute)
    close = (F.col("distance") <= 1) | (alike == 1.0) | (org & (F.least(F.length("a"), F.length("b")) >= 12))
    links = pairs.where(alike.isNotNull() & close).withColumn("score", score)
    links = links.select(F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"), "score")
    # A person's name whose given name no list holds reads like an organisation's: its words must all have a counterpart.
    person = classes.where("kind = 'person' AND length(attribute) = 1").select(F.col("core").alias("a"), "attribute", F.col("class_id").alias("class_p"))
    other = classes.where("kind = 'org' AND attribute = ''").select(F.col("core").alias("b"), "words", F.col("class_id").alias("class_o"))
    turned = worded.where("kind_a = 'person' AND kind_b = 'org'").join(person, "a").join(other, "b")
    turned = turned.where(F.exists("words", lambda x: (F.length(x) > 1) & x.startswith(F.col("attribute"))) & (F.size("words") >= 2))
    crossed = turned.select(F.least("class_p", "class_o").alias("class_a"), F.greatest("class_p", "class_o").alias("class_b"), F.lit(ALIKE).alias("score"))
    return members, links.where(F.col("score") >= ALIKE).unionByName(crossed).distinct()


#: Records of a class are paired in pieces of so many.
PIECE = 64


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of records of equal or linked classes: ``(party_id_a, party_id_b)``, smaller id first.

    Records that stand in the same classes form a group, so that every record is in one group alone and
    no pair comes out of two pairs of groups; the pairs themselves, by far the most rows, are neither shuffled nor compared.
    """
    per_id = members.groupBy("party_id").agg(F.array_sort(F.collect_set("class_id")).alias("of"))
    groups = cut(per_id.groupBy("of").agg(F.collect_list("party_id").alias("ids")).withColumn("g", F.array_min("ids")))
    classes = groups.select("g", F.explode("of").alias("class_id"))
    left, right = classes.select(F.col("g").alias("g_a"), F.col("class_id").alias("class_a")), classes.select(F.col("g").alias("g_b"), F.col("class_id").alias("class_b"))
    linked = links.select("class_a", "class_b").join(left, "class_a").join(right, "class_b").select("g_a", "g_b")
    shared = left.join(right, F.col("class_a") == F.col("class_b")).select("g_a", "g_b")
    both = linked.unionByName(shared).where("g_a <> g_b").select(F.least("g_a", "g_b").alias("g_a"), F.greatest("g_a", "g_b").alias("g_b")).distinct()
    both = both.unionByName(groups.where(F.size("ids") > 1).select(F.col("g").alias("g_a"), F.col("g").alias("g_b")))
    pieces = groups.select("g", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(PIECE)), lambda i: F.slice("ids", i, PIECE))).alias("k", "ids"))
    side = lambda x: pieces.select(*(F.col(c).alias(f"{c}_{x}") for c in ("g", "k", "ids")))
    met = both.join(side("a"), "g_a").join(side("b"), "g_b").where("g_a <> g_b OR k_a <= k_b")
    # Few rows here, many pairs out of each: a fixed number of tasks, not one that follows the bytes.
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("own", (F.col("g_a") == F.col("g_b")) & (F.col("k_a") == F.col("k_b")))
    pairs = met.select("own", F.explode("ids_a").alias("x"), "ids_b").select("own", "x", F.explode("ids_b").alias("y")).where("NOT own OR x < y")
    return pairs.select(F.least("x", "y").alias("party_id_a"), F.greatest("x", "y").alias("party_id_b"))


def found(parties: DataFrame) -> DataFrame:
    """Pairs of records whose company means the same organisation or person."""
    return expand(*link_names(parties))


def per_record(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: ``(party_id, class_id, n_links)``, its class and the number of classes linked to that."""
    both = links.select(F.col("class_a").alias("class_id")).unionByName(links.select(F.col("class_b").alias("class_id")))
    n = both.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(n, "class_id", "left").select("party_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes_with_links(parties: DataFrame) -> DataFrame:
    """One row per record, with the class of its exact name and the number of linked classes."""
    return per_record(*link_names(parties))
