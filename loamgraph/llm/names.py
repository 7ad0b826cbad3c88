"""Variant spellings of names typed by people.

1. Each name is read into words: accents, titles, legal forms, brackets, joined words and word order are
   taken off; c/k, ks/x, ph/f and y/i sound alike. What reads alike is one row from here on.
2. Misspelt words: a segment join over the *distinct* words. By the pigeonhole principle a word within k
   edits of another leaves one of its k+1 segments intact, at a place shifted by at most k; segments are
   looked up in an inverted index and the hits verified with a banded edit distance. Words are compared as
   they sound and as they are typed, as one slip may change more than one letter of the sound; the smaller
   distance counts. A word is corrected to the nearest word that is at least DOMINANCE times as frequent. Where none
   is, it is corrected to the more frequent one (the first in order if equal) if all other words of two names agree;
   then words of 4 letters may have two neighbours swapped. Other words up to 4 letters stay.
3. Nicknames become full names. A business word is written out if it is a known abbreviation, or if it shortens one
   word that stands in many names, or one beside the same other words (a prefix of it, or letters of it in order up to
   its end). The entity is the set of words.
4. A name of initial and surname, or with initials in place of two words (R&D) or of all (IBM), joins the only entity, or
   the one DOMINANCE times as frequent as the next, that it can mean; else it only equals its own kind. A lone surname
   means nobody else. Persons of one name with different middle initials are different persons; names without a middle
   initial are then a class of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

DOMINANCE = 2

# Common English short forms and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "al": "albert alan", "andy": "andrew", "barb": "barbara", "bea": "beatrice", "becky": "rebecca", "bella": "isabella",
    "ben": "benjamin", "benny": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert",
    "bobby": "robert", "charlie": "charles charlotte", "chris": "christopher christine", "chuck": "charles", "clare": "clarence", "dan": "daniel", "danny": "daniel", "dave": "david",
    "deb": "deborah", "debbie": "deborah", "dick": "richard", "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward",
    "ellie": "eleanor", "fran": "frances", "fred": "frederick", "freddie": "frederick", "gabe": "gabriel", "greg": "gregory", "gwen": "gwendolyn", "hank": "henry",
    "harry": "harriet henry harold", "hattie": "harriet", "howie": "howard", "ike": "isaac", "izzy": "isabella", "jack": "john", "jen": "jennifer", "jenny": "jennifer",
    "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "jonny": "jonathan", "kate": "katherine", "kathy": "katherine",
    "katie": "katherine", "ken": "kenneth", "kenny": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard",
    "lil": "lillian", "lily": "lillian", "lisa": "elizabeth", "liz": "elizabeth", "lottie": "charlotte", "maggie": "margaret", "matt": "matthew", "meg": "margaret",
    "mike": "michael", "mick": "michael", "nat": "natalie nathaniel", "nate": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas",
    "ollie": "oliver", "paddy": "patrick", "pat": "patrick patricia", "peg": "margaret", "peggy": "margaret", "penny": "penelope", "phil": "philip", "ray": "raymond",
    "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "sandy": "alexander", "sasha": "alexander", "steve": "stephen", "sue": "susan",
    "susie": "susan", "suzie": "susan", "ted": "edward theodore", "tess": "theresa", "tessa": "theresa", "terry": "theresa terence", "tim": "timothy", "tom": "thomas",
    "tommy": "thomas", "tony": "anthony", "val": "valerie", "vic": "victor victoria", "vicky": "victoria", "vince": "vincent", "wally": "walter", "walt": "walter",
    "will": "william", "winnie": "winifred",
}
#: Different other words beside which a business word must stand for shorter forms of it to be looked for.
COMPANY = 4

# Usual abbreviations of business words.
ABBREVIATIONS = {
    "assoc": "associates", "bldg": "building", "bros": "brothers", "centre": "center", "ctr": "center", "constr": "construction", "dept": "department", "dev": "development",
    "eng": "engineering", "engg": "engineering", "fdn": "foundation", "ins": "insurance", "inst": "institute", "intl": "international", "lab": "laboratories", "labs": "laboratories",
    "log": "logistics", "med": "medical", "mfg": "manufacturing", "mgmt": "management", "natl": "national", "pharma": "pharmaceuticals", "pub": "publishing", "publ": "publishing",
    "svc": "services", "svcs": "services", "sys": "systems", "tech": "technologies", "uni": "university", "univ": "university",
}
# Words that carry no identity.
TITLES = set("dr prof professor mr mrs ms miss mx sir dame".split())
SUFFIXES = set("phd md jr sr dds esq ii iii".split())
LEGAL = set("inc incorporated ltd limited llc corp corporation co company gmbh ag plc sa".split())
FILLER = set("the of and und for".split())
_LEET = str.maketrans("013457", "oleast")


def fold(word: str) -> str:
    """Sound-alike form; the first letter stays, so that initials remain comparable."""
    return word[:1] + word[1:].replace("ks", "x").replace("ph", "f").replace("c", "k").replace("y", "i")


_FORMAL = {fold(k): [fold(x) for x in v.split()] for k, v in NICKNAMES.items()}
_SAFE = set(_FORMAL) | {x for v in _FORMAL.values() for x in v} | {fold(x) for x in ABBREVIATIONS.values()} | {fold(x) for x in ABBREVIATIONS}
_SHORT = {fold(k): fold(v) for k, v in ABBREVIATIONS.items()}


def _words(text: str, person: bool) -> list[str]:
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m[0].replace(".", "") + " ", text) if not person else text
    text = re.sub(r"(?<=[a-z])and(?=[A-Z])", " and ", text)
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text) if not re.search(r"\s", text.strip()) else text
    text = re.sub(r"\b([A-Za-z]) ?& ?([A-Za-z])\b", r"\1&\2", text)
    out = []
    for w in re.findall(r"\b[a-z]&[a-z]\b|[^\W_]+(?:'[^\W_]+)?", text.lower().replace("_", " ")):
        w = w.replace("'", "")
        if re.search(r"[a-z]", w) and re.search(r"\d", w):
            w = w.translate(_LEET)
        out.append(w)
    return out


def read_name(kind: str, text: str) -> tuple[list[str], str, str]:
    """(words, initial, middle): the words as typed in their order, the initial of a person without a full given name, and one beside it."""
    words = _words(text, kind == "Person")
    if kind == "Person":
        full = [w for w in words if len(w) > 1 and w not in TITLES and w not in SUFFIXES]
        initials = [w for w in words if len(w) == 1]
        alone = len(full) == 1 and bool(initials)
        return full, initials[0] if alone else "", initials[0] if initials and len(full) > 1 else ""
    return [w for w in words if w not in LEGAL and w not in FILLER and len(w) > 1], "", ""


def osa_within(a: str, b: str, k: int) -> int:
    """Edit distance with neighbour swaps, in a band of width 2k+1; k+1 if it is larger than k."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = k + 1
    before, last = [], [j if j <= k else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        if i <= k:
            row[0] = i
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            y = b[j - 1]
            v = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row[j] = v
        if min(row) > k:
            return far
        before, last = last, row
    return min(last[-1], far)


def edits(n: int) -> int:
    """Edits allowed for a word of n letters."""
    return 0 if n < 5 else 1 if n < 12 else 2


def cuts(n: int) -> list[list[tuple[int, int]]]:
    """Ways to cut a word of n letters into edits(n)+1 segments. A swap across a border spoils two segments, so short words have two cuts."""
    if edits(n) == 2:
        return [[(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]]
    h = n // 2
    return [[(0, h), (h, n)], [(0, h - 1), (h - 1, n)]] if edits(n) else []


def _swapped(w: str) -> set[str]:
    return {"4s." + "".join(sorted(w))} if len(w) == 4 else set()


def near_enough(a: str, b: str) -> int:
    """The edits from a to b if b's length allows as many, else -1; between words of 4 letters one swap of neighbours."""
    k = edits(len(b))
    if len(a) == len(b) == 4:
        return 1 if sorted(a) == sorted(b) and osa_within(a, b, 1) == 1 else -1
    d = osa_within(a, b, k)
    return d if d <= k else -1


def index_keys(w: str) -> set[str]:
    n = len(w)
    return _swapped(w) | {f"{n}.{a}.{w[a:b]}" for c in cuts(n) for a, b in c}


def probe_keys(w: str) -> set[str]:
    out = _swapped(w)
    for n in range(len(w) - 2, len(w) + 3):
        k = edits(n)
        if not k or abs(n - len(w)) > k:
            continue
        for c in cuts(n):
            for a, b in c:
                for s in range(max(0, a - k), min(len(w) - (b - a), a + k) + 1):
                    out.add(f"{n}.{a}.{w[s : s + b - a]}")
    return out


def forms(word: str, typed: Iterable[str]) -> list[tuple[str, str]]:
    """(form, side) of a folded word: 's' as it sounds, 't' as typed, 'st' if it is typed as it sounds. An 's' and a 't' are not compared."""
    typed = set(typed)
    return [(word, "st" if word in typed else "s"), *((t, "t") for t in sorted(typed - {word}))]


def _keyed(make):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, w, n, f, s, x) for k, w, n, t in zip(p["kind"], p["word"], p["n"], p["typed"]) for f, s in forms(w, t) for x in make(f)]
            yield pd.DataFrame(rows, columns=["kind", "word", "n", "form", "side", "key"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(kind, word, n, right, n2, d) for folded words (kind, word, n, typed), typed being their spellings: d edits make word another word that is at least as frequent."""
    schema = "kind string, word string, n bigint, form string, side string, key string"
    probe = words.where(~F.col("word").isin(sorted(_SAFE))).mapInPandas(_keyed(probe_keys), schema)
    index = words.mapInPandas(_keyed(index_keys), schema)
    index = index.select(F.col("kind").alias("k2"), F.col("word").alias("right"), F.col("n").alias("n2"), F.col("form").alias("form2"), F.col("side").alias("side2"), F.col("key").alias("key2"))
    same = (F.col("key") == F.col("key2")) & (F.col("kind") == F.col("k2")) & (F.col("word") != F.col("right"))
    later = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("right") < F.col("word")))
    met = (F.col("side") == F.col("side2")) | (F.col("side") == "st") | (F.col("side2") == "st")
    hit = probe.join(index, same & later & met).select("kind", "word", "n", "right", "n2", "form", "form2").distinct()

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.assign(d=pd.Series([near_enough(a, b) for a, b in zip(p["form"], p["form2"])], dtype="int64", index=p.index))
            yield p.loc[p["d"] >= 0, ["kind", "word", "n", "right", "n2", "d"]]

    return cut(hit.mapInPandas(verify, "kind string, word string, n bigint, right string, n2 bigint, d bigint"))


def corrections(near: DataFrame) -> DataFrame:
    """(kind, word, right): the nearest word that is DOMINANCE times as frequent, of near_words."""
    sure = near.where((F.col("n2") >= DOMINANCE * F.col("n")) & (F.length("right") > 4))
    best = cut(sure.groupBy("kind", "word").agg(F.min(F.struct("d", (-F.col("n2")).alias("m"), "right")).alias("x")).select("kind", "word", F.col("x.right").alias("right")))
    nxt = best.select(F.col("kind").alias("k3"), F.col("word").alias("w3"), F.col("right").alias("r3"))
    return best.join(nxt, (F.col("kind") == F.col("k3")) & (F.col("right") == F.col("w3")), "left").select("kind", "word", F.coalesce("r3", "right").alias("right"))


def in_context(near: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, spelling, at, meant): words of names (kind, spelling, at, word) that are near another word beside the same other words."""
    beside = words.groupBy("kind", "spelling").agg(F.collect_list(F.struct("at", "word")).alias("all")).select("kind", "spelling", F.explode("all").alias("x"), "all")
    rest = F.array_join(F.array_sort(F.transform(F.filter("all", lambda y: y["at"] != F.col("x.at")), lambda y: y["word"])), " ")
    beside = beside.select("kind", "spelling", "x.at", "x.word", rest.alias("rest")).where("rest <> ''")
    other = beside.select("kind", F.col("word").alias("right"), "rest").distinct()
    hit = near.join(beside, ["kind", "word"]).join(other, ["kind", "right", "rest"])
    return hit.groupBy("kind", "spelling", "at").agg(F.min(F.struct("d", (-F.col("n2")).alias("m"), "right")).alias("x")).select("kind", "spelling", "at", F.col("x.right").alias("meant"))


def shortens(short: str, word: str) -> bool:
    """Whether short is a shorter form of word: a prefix of at least 3 letters, or letters of word in order, from its first to its last or last consonant (a final s aside)."""
    if len(word) < len(short) + 2 or short[:1] != word[:1] or len(short) < 2:
        return False
    if len(short) >= 3 and word.startswith(short):
        return True
    rest = iter(word)
    return all(c in rest for c in short) and short[-1] in (word[-1], re.sub(r"[aeiou]*s*$", "", word)[-1:])


def short_forms(words: DataFrame) -> DataFrame:
    """(kind, word, n, right, m, c) of organisations' words (kind, spelling, word) that shorten another; c counts the different words beside that."""
    org = words.where("kind = 'Organization'").select("kind", "spelling", "word").distinct()
    pair = org.join(org.select("spelling", F.col("word").alias("o")), "spelling").where("word <> o").select("kind", "word", "o").distinct()
    known = org.groupBy("kind", "word").agg(F.count("*").alias("n")).join(pair.groupBy("kind", "word").agg(F.count("*").alias("c")), ["kind", "word"])
    last, stem = F.substring("word", -1, 1), F.substring(F.regexp_replace("word", "[aeiou]*s*$", ""), -1, 1)
    ends = lambda x: F.concat(F.substring("word", 1, 1), F.lit("-"), x)
    long = known.where(F.length("word") >= 5).select("kind", F.col("word").alias("right"), F.col("n").alias("m"), "c", F.explode(F.array_distinct(F.array(F.substring("word", 1, 3), ends(last), ends(stem)))).alias("key"))
    short = known.where((F.length("word") <= 8) & ~F.col("word").isin(sorted(_SAFE))).select("kind", "word", "n", F.explode(F.array(F.substring("word", 1, 3), ends(last))).alias("key"))
    met = short.join(long, ["kind", "key"]).where(F.length("right") >= F.length("word") + 2).select("kind", "word", "n", "right", "m", "c").distinct()

    def fits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.loc[[shortens(a, b) for a, b in zip(p["word"], p["right"])]]

    return cut(met.mapInPandas(fits, met.schema))


def abbreviations(forms_: DataFrame) -> DataFrame:
    """(kind, word, right) of short_forms: the one word, or one DOMINANCE times as frequent as the next, that stands beside COMPANY others."""
    rank = Window.partitionBy("kind", "word").orderBy(F.desc("m"), "right")
    fit = forms_.where((F.col("c") >= COMPANY) & (F.col("m") >= DOMINANCE * F.col("n"))).select("*", F.row_number().over(rank).alias("r"), F.lead("m").over(rank).alias("m2"))
    return fit.where(f"r = 1 and (m2 is null or m >= {DOMINANCE} * m2)").select("kind", "word", "right")


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        got = [read_name(k, t) for k, t in zip(p["kind"], p["name"])]
        yield pd.DataFrame({"id": p["id"], "kind": p["kind"], "spelling": [" ".join(map(fold, w)) + ("|" + i if i else "") for w, i, _ in got], "typed": [" ".join(w) for w, _, _ in got], "middle": [m for _, _, m in got]})


def _organisation(words: list[str]) -> tuple[str, list[str], list[str]]:
    """(entity, loose, short) of an organisation's words in order."""
    entity = " ".join(sorted(set(words)))
    if any("&" in w for w in words):
        return entity, [entity], []
    if len(words) == 1:
        return entity, ["=" + words[0]] if 3 <= len(words[0]) <= 5 else [], []
    short = [" ".join(sorted({*words[:i], f"{words[i][0]}&{words[i + 1][0]}", *words[i + 2 :]})) for i in range(len(words) - 1)]
    return entity, [], short + (["=" + "".join(w[0] for w in words)] if 3 <= len(words) <= 5 else [])


def _formal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corrected spellings to candidate keys: (kind, spelling, entity, loose, short, n); loose entities must be found among the short keys of firm ones."""
    for p in parts:
        rows = []
        for kind, spelling, words, n in zip(p["kind"], p["spelling"], p["words"], p["n"]):
            words, initial = list(words), spelling.partition("|")[2]
            if kind != "Person":
                entity, loose, short = _organisation([_SHORT.get(w, w) for w in words])
                rows.append((kind, spelling, entity or "?" + spelling, loose, short, n))
                continue
            options = [_FORMAL.get(w, [w]) for w in words]
            first = sorted(o[0] for o in options)
            loose, short = [], []
            if len(words) == 1 and initial:
                loose = [f"{initial}. {options[0][0]}"]
                entity = loose[0]
            else:
                entity = " ".join(first) or "?" + spelling
                if len(words) > 1 and any(len(o) > 1 for o in options):
                    loose = [" ".join(sorted([*(x for j, x in enumerate(o[0] for o in options) if j != i), v])) for i, o in enumerate(options) if len(o) > 1 for v in o]
                elif len(first) == 2:
                    a, b = first
                    short = [entity, f"{a[0]}. {b}", f"{b[0]}. {a}"]
            rows.append((kind, spelling, entity, loose, short, n))
        yield pd.DataFrame(rows, columns=["kind", "spelling", "entity", "loose", "short", "n"])


def entities(names: DataFrame) -> DataFrame:
    """(id, kind, entity) for names (id, kind, name); kind is 'Person' or 'Organization'.

    Rows with a null id, kind or name name nothing and are left out. Names without any letter equal only
    the same spelling. One id may occur once only.
    """
    read = cut(names.where("id is not null and kind is not null and name is not null").select("id", "kind", "name").mapInPandas(_read, "id bigint, kind string, spelling string, typed string, middle string"))
    spelt = read.groupBy("kind", "spelling").agg(F.count("*").alias("n"))
    split = spelt.select("kind", "spelling", "n", F.posexplode(F.split(F.substring_index("spelling", "|", 1), " ")).alias("at", "word"))
    words = cut(split)
    pairs = F.expr("zip_with(split(substring_index(spelling, '|', 1), ' '), split(typed, ' '), (x, y) -> struct(x as word, y as typed))")
    typed = read.groupBy("kind", "spelling", "typed").agg(F.count("*").alias("n")).select("kind", "n", F.explode(pairs).alias("x")).select("kind", "n", "x.word", "x.typed")
    near = near_words(typed.where("word <> '' and instr(word, '&') = 0").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.collect_set("typed").alias("typed")))
    fix = corrections(near)
    shorter = short_forms(words.where("word <> '' and instr(word, '&') = 0"))
    longer = abbreviations(shorter).join(fix.select("kind", "word"), ["kind", "word"], "left_anti")
    fix = cut(fix.unionByName(longer))
    mended = cut(words.join(fix, ["kind", "word"], "left").select("kind", "spelling", "n", "at", F.coalesce("right", "word").alias("word")))
    rare = near.select("kind", "word", "right", "n2", "d").unionByName(shorter.select("kind", "word", "right", F.col("m").alias("n2"), F.lit(1).cast("bigint").alias("d"))).join(fix, ["kind", "word"], "left_anti")
    right = (
        mended.join(in_context(rare, mended.where("word <> ''")), ["kind", "spelling", "at"], "left")
        .groupBy("kind", "spelling", "n")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("meant", "word").alias("w")))).alias("x"))
        .select("kind", "spelling", "n", F.expr("filter(transform(x, y -> y.w), w -> w <> '')").alias("words"))
    )
    keyed = cut(right.mapInPandas(_formal, "kind string, spelling string, entity string, loose array<string>, short array<string>, n bigint"))
    firm = keyed.where("size(short) > 0").groupBy("kind", "entity").agg(F.sum("n").alias("m"), F.first("short").alias("short"))
    short = firm.select("kind", F.col("entity").alias("firm"), "m", F.explode("short").alias("key"))
    asked = keyed.where("size(loose) > 0").select("kind", "spelling", "entity", F.explode("loose").alias("key")).distinct()
    rank = Window.partitionBy("kind", "spelling").orderBy(F.desc("m"), "firm")
    chosen = (
        asked.join(short, ["kind", "key"])
        .select("kind", "spelling", "firm", "m", F.row_number().over(rank).alias("r"), F.lead("m").over(rank).alias("m2"))
        .where(f"r = 1 and (m2 is null or m >= {DOMINANCE} * m2)")
        .select("kind", "spelling", "firm")
    )
    final = keyed.join(chosen, ["kind", "spelling"], "left").select("kind", "spelling", F.coalesce("firm", "entity").alias("entity"))
    named = cut(read.join(final, ["kind", "spelling"]).select("id", "kind", "entity", "middle"))
    several = named.where("middle <> ''").groupBy("kind", "entity").agg(F.countDistinct("middle").alias("k")).where("k > 1").select("kind", "entity", "k")
    apart = F.when(F.col("k").isNull() | (F.col("middle") == ""), F.col("entity")).otherwise(F.concat("entity", F.lit(" "), "middle"))
    return named.join(several, ["kind", "entity"], "left").select("id", "kind", apart.alias("entity"))


def same_entity_pairs(found: DataFrame) -> DataFrame:
    """All pairs node_id_a < node_id_b of one entity."""
    b = found.select(F.col("id").alias("node_id_b"), F.col("kind").alias("kb"), F.col("entity").alias("eb"))
    return (
        found.join(b, (F.col("kind") == F.col("kb")) & (F.col("entity") == F.col("eb")) & (F.col("id") < F.col("node_id_b")))
        .select(F.col("id").alias("node_id_a"), "node_id_b")
    )


def entity_classes(found: DataFrame) -> DataFrame:
    """(id, class_id, n_links): one row per name; class_id is the smallest id of the entity."""
    per = found.groupBy("kind", "entity").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("n_links"))
    return found.join(per, ["kind", "entity"]).select("id", "class_id", "n_links")
