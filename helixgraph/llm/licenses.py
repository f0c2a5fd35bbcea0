"""License scans: ordered signature rules, gated by keywords, over the words of whole texts. All of it is column functions.

A signature is a short regular expression over words joined by single spaces. Its keyword, in angle brackets, has a fixed
number of words before it, so an occurrence of the keyword says where a match would begin: rules are tried at the places of
their keywords only, on the few words around them. What overlaps is resolved by length and priority.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels. Their places are counted whatever else matches.
BASE = (
    ("<gnu> general public license", "gpl"),
    ("<apache> license", "apache"),
    ("<cc> by", "cc-by"),
    ("mit <license>", "mit"),
)
#: Licenses by label: names as they are written in prose and in package metadata, each with its keyword.
NAMES = {
    "gpl": ("<gnu> general public license",),
    "apache": ("<apache> license",),
    "gpl-1.0": ("<gnu> general public license( version| v)? 1( 0)?", "<gpl>( version| v)? 1( 0)?", "<gplv1>"),
    "gpl-2.0": ("<gnu> general public license( version| v)? 2( 0)?", "<gpl>( version| v)? 2( 0)?", "<gplv2>"),
    "gpl-3.0": ("<gnu> general public license( version| v)? 3( 0)?", "<gpl>( version| v)? 3( 0)?", "<gplv3>"),
    "gpl-2.0-or-later": ("<gnu> general public license( version| v)? 2( 0)? or( any)? later", "<gpl>( version)? 2( 0)? or later", "<gplv2> or later"),
    "gpl-3.0-or-later": ("<gnu> general public license( version| v)? 3( 0)? or( any)? later", "<gpl>( version)? 3( 0)? or later", "<gplv3> or later"),
    "lgpl": ("<gnu> (lesser|library) general public license", "<lgpl>"),
    "lgpl-2.1": ("<gnu> lesser general public license( version| v)? 2 1", "<lgpl>( version| v)? 2 1", "<lgplv2> 1"),
    "lgpl-3.0": ("<gnu> lesser general public license( version| v)? 3( 0)?", "<lgpl>( version| v)? 3( 0)?", "<lgplv3>"),
    "agpl-3.0": ("<gnu> affero general public license(( version| v)? 3( 0)?)?", "<agpl>(( version| v)? 3( 0)?)?", "<agplv3>"),
    "gfdl": ("<gnu> free documentation license(( version| v)? 1 [123])?", "<gfdl>( 1 [123])?"),
    "apache-1.1": ("<apache> (software )?license( version| v)? 1 1",),
    "apache-2.0": ("<apache> (software )?license( version| v)? 2( 0)?", "<apache>( version| v)? 2( 0)?"),
    "mit": ("mit <license>", "<expat> license", "mit expat <license>", "mit x11 <license>"),
    "mit-0": ("mit no attribution <license>", "mit 0 <license>"),
    "x11": ("x11 <license>", "x consortium <license>"),
    "bsd": ("<bsd> license", "<bsd> style license"),
    "bsd-2-clause": ("<bsd> 2 clause( license)?", "2 clause <bsd>( license)?", "simplified <bsd>( license)?", "freebsd <license>"),
    "bsd-3-clause": ("<bsd> 3 clause( license)?", "3 clause <bsd>( license)?", "new <bsd>( license)?", "revised <bsd>( license)?", "modified <bsd>( license)?"),
    "bsd-4-clause": ("<bsd> 4 clause( license)?", "4 clause <bsd>( license)?", "original <bsd>( license)?"),
    "0bsd": ("<0bsd>", "zero clause <bsd>( license)?"),
    "isc": ("isc <license>", "internet systems consortium <license>"),
    "zlib": ("zlib <license>", "zlib libpng <license>"),
    "libpng": ("libpng <license>",),
    "boost": ("<boost> software license(( version)? 1 0)?", "<bsl> 1 0"),
    "mpl-1.1": ("<mozilla> public license( version| v)? 1 [01]", "<mpl>( version)? 1 [01]"),
    "mpl-2.0": ("<mozilla> public license(( version| v)? 2( 0)?)?", "<mpl>( version)? 2( 0)?", "<mplv2>"),
    "epl-1.0": ("<eclipse> public license( version| v)? 1( 0)?", "<epl>( version)? 1( 0)?"),
    "epl-2.0": ("<eclipse> public license(( version| v)? 2( 0)?)?", "<epl>( version)? 2( 0)?"),
    "edl": ("<eclipse> distribution license(( version)? 1 0)?",),
    "cddl": ("common development and distribution <license>(( version)? 1 [01])?", "<cddl>( 1 [01])?"),
    "cpl": ("common public <license>( version)? 1 0", "ibm public <license>"),
    "eupl": ("european union public <licen[cs]e>(( version| v)? 1 [012])?", "<eupl>(( version| v)? 1 [012])?"),
    "osl-3.0": ("open software <license>(( version| v)? 3 0)?", "<osl> 3 0"),
    "afl": ("academic free <license>(( version| v)? [23] [01])?",),
    "artistic": ("artistic <license>(( version)? [12] 0)?", "perl artistic <license>"),
    "python": ("python software foundation <license>", "<psf> license", "python <license>"),
    "php": ("php <license>(( version| v)? 3 0[1]?)?",),
    "ruby": ("ruby <license>",),
    "openssl": ("<openssl> license", "<ssleay> license"),
    "ofl": ("<sil> open font license(( version)? 1 1)?", "open font <license>", "<ofl> 1 1"),
    "cc0": ("creative <commons> zero", "creative <commons> cc0", "<cc0>( 1 0)?"),
    "cc-by": ("creative <commons> attribution", "<cc> by( [1234] [05])?"),
    "cc-by-sa": ("creative <commons> attribution share ?alike", "<cc> by sa( [1234] [05])?"),
    "cc-by-nc": ("creative <commons> attribution non ?commercial", "<cc> by nc( [1234] [05])?"),
    "cc-by-nd": ("creative <commons> attribution no ?derivatives", "creative <commons> attribution no ?derivs", "<cc> by nd( [1234] [05])?"),
    "cc-by-nc-sa": ("creative <commons> attribution non ?commercial share ?alike", "<cc> by nc sa( [1234] [05])?"),
    "cc-by-nc-nd": ("creative <commons> attribution non ?commercial no ?(derivatives|derivs)", "<cc> by nc nd( [1234] [05])?"),
    "odbl": ("open database <license>(( version| v)? 1 0)?", "<odbl>( 1 0)?"),
    "odc-by": ("open data commons attribution <license>",),
    "pddl": ("public domain dedication and <license>", "<pddl>( 1 0)?"),
    "unlicense": ("the <unlicense>", "<unlicense>"),
    "wtfpl": ("<wtfpl>", "do what the fuck you want to public <license>"),
    "public-domain": ("released into the public <domain>", "dedicated to the public <domain>", "in the public <domain>"),
    "postgresql": ("postgresql <license>",),
    "ncsa": ("university of illinois ncsa open source <license>", "ncsa open source <license>"),
    "upl": ("universal permissive <license>(( version)? 1 0)?",),
    "bsl-1.1": ("business source <license>(( version)? 1 1)?",),
    "sspl": ("server side public <license>(( version| v)? 1)?", "<sspl>( 1 0)?"),
    "elastic": ("<elastic> license(( version)? 2 0)?",),
    "ms-pl": ("microsoft public <license>", "ms <pl>"),
    "ms-rl": ("microsoft reciprocal <license>",),
    "w3c": ("<w3c> software( notice and)? license", "<w3c> license"),
    "unicode": ("unicode <license>( v3)?", "unicode terms of <use>"),
    "vim": ("vim <license>", "charityware <license>"),
    "json": ("json <license>",),
    "beerware": ("beer ware <license>", "beerware <license>"),
    "openrail": ("creativeml open rail m <license>", "bigscience open rail m <license>", "<openrail>( m)?"),
    "llama": ("llama [234] community <license>", "community <license> agreement"),
    "proprietary": ("all <rights> reserved", "proprietary and <confidential>", "unauthorized copying is strictly <prohibited>"),
}
#: What announces a license; (words before the name, priority, weight): a smaller priority wins, weights are confidences.
FORMS = (
    ("spdx license identifier ", 0, 1.0),
    ("licensed under the ", 1, 0.95),
    ("licensed under ", 1, 0.95),
    ("released under the ", 1, 0.95),
    ("released under ", 1, 0.95),
    ("distributed under the ", 1, 0.9),
    ("available under the ", 1, 0.9),
    ("under the terms of the ", 1, 0.9),
    ("governed by the ", 2, 0.85),
    ("subject to the ", 2, 0.85),
    ("", 3, 0.6),
)


@dataclass(frozen=True)
class Name:
    """A signature over words, the word that gates it, the words before that one, and the label that it gives."""

    keyword: str
    lead: int
    body: str
    label: str
    base: bool = False

    @property
    def longest(self) -> int:
        """No match has more words: patterns repeat nothing, so each blank in one stands for one at most."""
        return self.body.count(" ") + 1


def _name(text: str, label: str, base: bool = False) -> list[Name]:
    before, _, after = text.partition("<")
    keyword, _, after = after.partition(">")
    spelled = [keyword.replace("[cs]", x) for x in "cs"] if "[cs]" in keyword else [keyword]
    return [Name(k, before.count(" "), before + k + after, label, base) for k in spelled]


def signatures(names: dict[str, tuple[str, ...]] | None = None) -> list[Name]:
    """The base phrases, then every name, in order. With the forms they make the rules: rule n * len(FORMS) + f is name n in
    form f; base phrases have the plain form only."""
    out = [x for text, label in BASE for x in _name(text, label, True)]
    return out + [x for label, texts in (NAMES if names is None else names).items() for text in texts for x in _name(text, label)]


#: What stands between words, besides the blank: all of ASCII but digits and letters.
_APART = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def joined_words(text: Column) -> Column:
    """The words of a text, A to Z in small letters, with single blanks between them; null as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), _APART + _UPPER, " " * len(_APART) + _UPPER.lower())
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def count_words(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def _part(text: Column, pattern: Column, group: int) -> Column:
    """A group of a pattern that varies by row."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def scan(df: DataFrame, id_column: str, text_column: str, names: list[Name] | None = None) -> DataFrame:
    """(id, n_words, base, found) for every row: arrays of (start, end, priority, rule, label, weight), places in words from 0.

    ``base`` has all places of the base phrases. ``found`` has what is left of all detections: of those that begin at one
    word the longest, of equal spans the one of the smaller priority, then of the earlier rule; none that lies within
    another's span; and none that crosses one of a smaller priority. Words are runs of ASCII letters and digits and of all
    that isn't ASCII. A null or empty text, or one without any keyword, has empty arrays. Repeated rows and null ids are
    rows like others; an empty table gives an empty result. No row leaves its partition: there is no shuffle, and work
    grows with the length of texts and with the places of keywords in them. Forms are tried only where a name is found.
    """
    names = signatures() if names is None else names
    told = max(prefix.count(" ") for prefix, _, _ in FORMS)
    ahead = max(x.lead for x in names) + told + 1
    longest = max(x.longest for x in names) + told
    by_keyword: dict[str, list] = {}
    for n, x in enumerate(names):
        pattern = f"^((?:[^ ]+ ){{{ahead - x.lead}}})({x.body})(?= |$)"
        by_keyword.setdefault(x.keyword, []).append(F.struct(F.lit(x.lead).alias("lead"), F.lit(pattern).alias("pattern"), F.lit(n).alias("name"), F.lit(x.label).alias("label"), F.lit(x.base).alias("base")))
    tried = F.create_map(*(x for k, v in by_keyword.items() for x in (F.lit(k), F.array(*v))))
    forms = F.array(*(F.struct(F.lit(f" {prefix}" if prefix else "").alias("prefix"), F.lit(prefix.count(" ")).alias("words"), F.lit(priority).alias("priority"), F.lit(weight).alias("weight"), F.lit(n).alias("form")) for n, (prefix, priority, weight) in enumerate(FORMS)))
    gate = F.concat(F.lit(" "), F.col("_joined"), F.lit(" ")).rlike(f" (?:{'|'.join(by_keyword)}) ")

    rows = df.select(F.col(id_column).alias("_id"), joined_words(F.col(text_column)).alias("_joined"))
    rows = rows.select("_id", count_words(F.col("_joined")).alias("n_words"), F.when(gate, F.split("_joined", " ")).alias("_words"))
    places = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(list(by_keyword)))
    # marks before the first word, so that the words around a keyword have a fixed number ahead of it
    rows = rows.select("_id", "n_words", F.concat(F.array_repeat(F.lit("-"), ahead), F.col("_words")).alias("_padded"), places.alias("_places"))
    near = F.transform("_places", lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word"), F.array_join(F.slice("_padded", x["at"] + 1, ahead + longest), " ").alias("near")))
    rows = rows.select("_id", "n_words", near.alias("_near"))

    def named(x: Column) -> Column:
        def one(r: Column) -> Column:
            size = count_words(_part(x["near"], r["pattern"], 2)).cast("int")
            return F.struct((x["at"] - r["lead"]).alias("start"), size.alias("size"), x["near"].alias("near"), r.alias("r"))

        return F.filter(F.transform(tried[x["word"]], one), lambda d: d["size"] > 0)

    def formed(d: Column) -> Column:
        r = d["r"]
        before = _part(d["near"], r["pattern"], 1)
        fits = F.filter(forms, lambda f: (f["words"] == 0) | (~r["base"] & F.endswith(before, f["prefix"])))
        return F.transform(fits, lambda f: F.struct((d["start"] - f["words"]).alias("start"), (d["start"] + d["size"]).alias("end"), f["priority"].alias("priority"), (r["name"] * len(FORMS) + f["form"]).alias("rule"), r["label"].alias("label"), f["weight"].alias("weight"), r["base"].alias("base")))

    every = F.flatten(F.transform(F.flatten(F.transform("_near", named)), formed))
    rows = rows.select("_id", "n_words", F.coalesce(every, F.array().cast(_DETECTIONS)).alias("_all"))
    rank = lambda d: F.struct(d["start"], -d["end"], d["priority"], d["rule"])
    ordered = F.array_sort("_all", lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0))
    rows = rows.withColumn("_all", ordered)
    # the longest of those that begin at a word; from here on a start is unique, so no more than longest - 1 stand before one
    # and can reach it
    rows = rows.withColumn("_one", F.filter("_all", lambda d, i: (i == 0) | (F.try_element_at("_all", F.greatest(i, F.lit(1)))["start"] != d["start"])))
    before = lambda name, i: F.slice(name, F.greatest(i - (longest - 1), F.lit(0)) + 1, F.least(i, F.lit(longest - 1)))
    rows = rows.withColumn("_whole", F.filter("_one", lambda d, i: ~F.exists(before("_one", i), lambda e: e["end"] >= d["end"])))
    beside = lambda i: F.slice("_whole", F.greatest(i - (longest - 1), F.lit(0)) + 1, F.lit(2 * longest - 1))
    crossed = lambda d, i: F.exists(beside(i), lambda e: (e["start"] < d["end"]) & (d["start"] < e["end"]) & (e["priority"] < d["priority"]))
    rows = rows.withColumn("_found", F.filter("_whole", lambda d, i: ~crossed(d, i)))
    return rows.select(F.col("_id").alias(id_column), "n_words", F.filter("_all", lambda d: d["base"]).alias("base"), F.col("_found").alias("found"))


_DETECTIONS = "array<struct<start:int,end:int,priority:int,rule:int,label:string,weight:double,base:boolean>>"


def summary(scanned: DataFrame) -> DataFrame:
    """Adds n_base, first_word and last_word (the base phrases' places), base_labels and labels (sorted, joined by commas; the
    base phrases' labels stay whatever covers them) and score: the greatest weight of what was found, 0 without any."""
    def labels(*columns: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda d: d["label"]) for c in columns)))), ",")

    starts = F.transform("base", lambda d: d["start"].cast("long"))
    return (
        scanned.withColumn("n_base", F.size("base").cast("long"))
        .withColumn("first_word", F.array_min(starts))
        .withColumn("last_word", F.array_max(starts))
        .withColumn("base_labels", labels("base"))
        .withColumn("labels", labels("base", "found"))
        .withColumn("score", F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)))
    )
