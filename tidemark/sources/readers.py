"""Readers of matrices, stores and annotation files. Nothing is downloaded: every source is a path or a DataFrame."""

from __future__ import annotations

import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix_csv(spark: SparkSession, path: str, keys: int = 2) -> tuple[DataFrame, list[float]]:
    """(signals(source, id[, rep], x), times) of a CSV whose header is key names, then time points."""
    raw = spark.read.option("header", True).csv(path)
    names, cells = ["source", "id", "rep"][:keys], raw.columns[keys:]
    value = lambda c: F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double"))
    return raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names, strict=False)], F.array(*[value(c) for c in cells]).alias("x")), [float(c) for c in cells]


def unzip(path: str, to: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        z.extractall(to)
        return z.namelist()


class Store:
    """Named tables under a root folder; a name that isn't there reads as None."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, name: str, json: bool = False) -> None:
        w = df.write.mode("overwrite")
        w.option("compression", "gzip").json(f"{self.root}/{name}.json") if json else w.parquet(f"{self.root}/{name}")

    def read(self, name: str, json: bool = False) -> DataFrame | None:
        try:
            return self.spark.read.json(f"{self.root}/{name}.json") if json else self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(term, name, namespace) of the [Term] stanzas of an OBO file, obsolete ones too, by key and not by position."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    field = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}: *(.*?)\s*$", 1), F.lit(""))
    return stanza.select(field("id").alias("term"), field("name").alias("name"), field("namespace").alias("namespace"))


def annotations(spark: SparkSession, path: str, id_column: int = 2, term_column: int = 5) -> DataFrame:
    """(id, term): two columns, counted from 1, of a tab-separated file whose comments start with `!`."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("!"))
    pick = lambda n: F.nullif(F.coalesce(F.get(parts, F.lit(n - 1)), F.lit("")), F.lit(""))
    return rows.select(pick(id_column).alias("id"), pick(term_column).alias("term")).where("id is not null and term is not null").distinct()


def links(spark: SparkSession, path: str) -> DataFrame:
    """(id, term) of a two-column tab-separated link table."""
    return spark.read.option("sep", "\t").schema("term string, id string").csv(path).select("id", "term").where("id is not null and term is not null").distinct()


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("term string, name string").csv(path).withColumn("namespace", F.lit(None).cast("string"))


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """(pumchem, cpd): the two-column dictionary of compound ids, without quotation marks."""
    raw = spark.read.option("quote", "").schema("a string, b string").csv(path)
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(c, "[\"']", "")), F.lit(""))
    return raw.select(bare("a").alias("pumchem"), bare("b").alias("cpd"))


def masses(spark: SparkSession, path: str) -> DataFrame:
    """(species, compound, mass); the species is what stands before the colon of the first compound's id, by row here."""
    raw = spark.read.schema("compound string, mass double").csv(path)
    return raw.where("mass is not null").select(F.split_part("compound", F.lit(":"), F.lit(1)).alias("species"), "compound", "mass")


def cross_reference(main: DataFrame, *others: DataFrame, on: str = "kg_id") -> DataFrame:
    """Left joins on one key; empty strings become null, and `kegg` keeps what follows its plus sign."""
    out = main
    for t in others:
        out = out.join(t, on, "left")
    out = out.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if dict(out.dtypes)[c] == "string" else F.col(c) for c in out.columns])
    return out.withColumn("kegg", F.nullif(F.split_part("kegg", F.lit("+"), F.lit(2)), F.lit(""))) if "kegg" in out.columns else out


class _Parser:
    """Recursive descent over nested associations <| key -> value, ... |>, lists {...}, strings, numbers and names."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, token: str) -> bool:
        self.blank()
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise ValueError(f"{token!r} expected at {self.at}: {self.text[self.at : self.at + 20]!r}")

    def items(self, close: str, one) -> list:
        out = []
        if self.take(close):
            return out
        while True:
            out.append(one())
            if self.take(close):
                return out
            self.need(",")

    def entry(self):
        key = self.value()
        self.need("->")
        return key, self.value()

    def value(self):
        if self.take("<|"):
            return [("->", *e) for e in self.items("|>", self.entry)]
        if self.take("{"):
            return self.items("}", self.value)
        if self.take('"'):
            out = []
            while self.text[self.at] != '"':
                self.at += self.text[self.at] == "\\"
                out.append(self.text[self.at])
                self.at += 1
            self.at += 1
            return "".join(out)
        self.blank()
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ",{}|<>\"" and not self.text.startswith("->", self.at):
            self.at += 1
        word = self.text[start : self.at].strip()
        if word in ("Missing[]", "None", "Null"):
            return None
        try:
            return float(word.replace("*^", "e"))
        except ValueError:
            return word


def parse_associations(text: str):
    """The nested value of an association file; an association is a list of ("->", key, value)."""
    p = _Parser(text)
    out = p.value()
    p.blank()
    if p.at != len(text):
        raise ValueError(f"text after the value at {p.at}")
    return out


def classified_signals(spark: SparkSession, path: str) -> DataFrame:
    """(class, id, label, classifier, series) of <| class -> <| {id, label} -> {classifier, series} |> |> files, one text a task."""
    schema = "class string, id string, label string, classifier array<double>, series array<double>"

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for text in f["value"]:
                for _, name, members in parse_associations(text):
                    for _, key, pair in members:
                        key = key if isinstance(key, list) else [key]
                        rows.append((str(name), str(key[0]), str(key[1]) if len(key) > 1 else None, pair[0], pair[1]))
            yield pd.DataFrame(rows, columns=["class", "id", "label", "classifier", "series"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)
