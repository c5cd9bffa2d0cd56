"""Synthesizers over DataFrames: ``fit(df, schema)``, ``sample(spark, n)``, ``report()``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.functions import hash_uniform
from privloom.operators import clustered as C
from privloom.operators import encode as E
from privloom.operators import graphical as G
from privloom.operators import network as N
from privloom.operators.cliques import grow_cliques
from privloom.operators.inference import infer
from privloom.operators.compression import Compression
from privloom.operators.privacy import SecureNoise, rho_of
from privloom.schema import Schema


@dataclass
class Codec:
    """Columns to codes and back, by the schema alone: it never reads the data."""

    schema: Schema
    bins: int = 16
    nan_bins: tuple[str, ...] = ()

    def numeric(self, name: str) -> E.Numeric:
        lo, hi = self.schema.bounds[name]
        return E.Numeric.equal(lo, hi, self.schema.bins.get(name, self.bins), name in self.nan_bins)

    def size(self, name: str) -> int:
        kind = self.schema.kinds[name]
        if kind == "binary":
            return 2
        return len(self.schema.categories[name]) if self.schema.categories.get(name) else self.numeric(name).size

    def sizes(self) -> dict[str, int]:
        return {n: self.size(n) for n in self.schema.kinds}

    def encode(self, df: DataFrame) -> DataFrame:
        out = []
        for n, kind in self.schema.kinds.items():
            c = F.col(f"`{n}`")
            code = E.binary(c.cast("string")) if kind == "binary" else E.encode_category(c, self.schema.categories[n], unknown=False) if self.schema.categories.get(n) else self.numeric(n).encode(c.cast("string"))
            out.append(code.cast("int").alias(n))
        return df.select(*out)

    def decode(self, codes: DataFrame, id_column: str, seed: str) -> DataFrame:
        out = []
        for n, kind in self.schema.kinds.items():
            c = F.col(f"`{n}`")
            if kind == "binary":
                value = c
            elif self.schema.categories.get(n):
                value = E.decode_category(c, self.schema.categories[n])
            else:
                value = self.numeric(n).decode(c, hash_uniform(seed, f"{n}|decode", F.col(id_column)), kind != "continuous")
                value = value if kind == "continuous" else value.cast("long")
            out.append(value.alias(n))
        return codes.select(id_column, *out)


@dataclass
class NetworkEngine:
    """Parents by noisy mutual information, conditional tables with Laplace noise. A schema's extensions say which columns come first, which parents are
    forbidden, how many there may be (``most_parents`` at most) and how much each table is smoothed (where ``alpha`` is None)."""

    epsilon: float | None = 1.0
    most_parents: int = 2
    alpha: float | None = 1.5
    temperature: float = 1.0
    noise: SecureNoise = field(default_factory=SecureNoise)

    def fit(self, df: DataFrame, schema: Schema | None = None) -> "NetworkEngine":
        """Without a schema one is inferred from the rows, which the report says."""
        self.inferred = schema is None
        schema = schema or Schema.parse(infer(df))
        schema.check_rows(df.count())
        self.codec = Codec(schema)
        more = schema.rest.get("extensions") or {}
        order = N.column_order(list(schema.kinds), more.get("partial_order") or ())
        alpha = (more.get("alpha") or 1.5) if self.alpha is None else self.alpha
        coded = self.codec.encode(df).persist()
        try:
            self.net = N.fit(coded, self.codec.sizes(), order, self.epsilon, min(self.most_parents, more.get("max_parents") or self.most_parents), alpha, self.noise, more.get("forbidden_parents"))
        finally:
            coded.unpersist()
        return self

    def sample(self, spark: SparkSession, n: int, seed: str = "sample", temperature: float | None = None) -> DataFrame:
        rows = spark.range(n).withColumnRenamed("id", "__id")
        codes = self.net.sample(rows, "__id", seed=seed, temperature=temperature or self.temperature)
        return self.codec.decode(codes, "__id", seed).drop("__id")

    def report(self) -> dict:
        return {"epsilon_total": self.epsilon, "epsilon_structure": self.net.spent["structure"], "epsilon_cpt": self.net.spent["tables"], "epsilon_metadata": 0.0, "delta": 0.0,
                "mechanism_structure": "laplace", "mechanism_cpt": "laplace", "metadata_source": "inferred from the rows, not private" if self.inferred else "public schema", "undeclared": ["schema inferred from the rows"] if self.inferred else [], "adjacency": "add or remove a row", "composition": "sequential"}


@dataclass
class GraphicalEngine:
    """Cliques of ``degree`` columns chosen by the exponential mechanism on information, Gaussian marginals under zCDP, a fitted graphical model.

    ``compress`` pools the levels that noise hides, by the columns' own noisy counts; ``zeros`` names codes of a column that can't occur.
    """

    epsilon: float | None = 1.0
    delta: float = 1e-5
    steps: int = 500
    noise: SecureNoise = field(default_factory=SecureNoise)
    degree: int = 2
    most_cells: float | None = None
    compress: bool = False
    zeros: dict[str, list[int]] | None = None

    def fit(self, df: DataFrame, schema: Schema) -> "GraphicalEngine":
        rows = df.count()
        schema.check_rows(rows)
        self.codec = Codec(schema)
        coded = self.codec.encode(df).persist()
        try:
            names, sizes = list(schema.kinds), self.codec.sizes()
            half = self.epsilon / 2 if self.epsilon else None
            singles = [(n,) for n in names]
            self.pools, known, used = None, [], coded
            if self.compress or self.zeros:
                # half of what the tables may cost goes to the columns' own counts
                ones = G.measure(coded, G.Domain(sizes), singles, half / 2 if half else None, self.delta / 2, self.noise)
                measured = {c[0]: (v, s if half else 0.0) for c, v, s in ones} if self.compress else {}
                self.pools = Compression.learn(sizes, measured, self.zeros)
                known = [self.pools.measurement(c[0], v, s) for c, v, s in ones]
                used, sizes = self.pools.encode(coded), self.pools.new_sizes()
            cliques = grow_cliques(used, sizes, self.degree, half, most_cells=self.most_cells, noise=self.noise)
            domain = G.Domain(sizes)
            left = half / 2 if half and known else half
            delta = self.delta / 2 if known else self.delta
            measured = known + G.measure(used, domain, cliques if known else [*cliques, *[s for s in singles if s not in cliques]], left, delta, self.noise)
            self.model = G.Model(domain, cliques, G.total_of(measured))
            self.model.fit(measured, self.steps)
        finally:
            coded.unpersist()
        return self

    def sample(self, spark: SparkSession, n: int, seed: str = "sample") -> DataFrame:
        rows = spark.range(n).withColumnRenamed("id", "__id")
        codes = self.model.sample(rows, "__id", seed)
        codes = self.pools.decode(codes, "__id", seed) if self.pools else codes
        return self.codec.decode(codes, "__id", seed).drop("__id")

    def report(self) -> dict:
        half = self.epsilon / 2 if self.epsilon else None
        return {"epsilon_total": self.epsilon, "epsilon_structure": half, "epsilon_cpt": half, "epsilon_metadata": 0.0, "delta": self.delta, "mechanism_structure": "exponential",
                "mechanism_cpt": f"gaussian, rho {rho_of(half, self.delta):.6g}" if half else None, "metadata_source": "public schema", "adjacency": "add or remove a row", "composition": "zcdp"}


@dataclass
class LearnedCodec:
    """Columns to codes and back by what the rows hold: values of their own, or equal bins for numbers of more than ``bins`` values. Not private."""

    dictionaries: dict[str, list[str]]
    numeric: dict[str, E.Numeric]
    types: dict[str, str]

    #: Values of a column that is not binned.
    MOST = 100_000

    @classmethod
    def learn(cls, df: DataFrame, bins: int) -> "LearnedCodec":
        types = dict(df.dtypes)
        number_like = [c for c, t in types.items() if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
        row = df.agg(*[F.count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(types)], *[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(types) if c in number_like for n, f in (("lo", F.min), ("hi", F.max))]).first()
        numeric, dictionaries = {}, {}
        for i, c in enumerate(types):
            if c in number_like and row[f"d{i}"] > bins:
                lo, hi = row[f"lo{i}"], row[f"hi{i}"]
                numeric[c] = E.Numeric.equal(lo, hi, bins, True)
            elif row[f"d{i}"] > cls.MOST:
                raise ValueError(f"{c}: more than {cls.MOST} values")
            else:
                dictionaries[c] = [r[0] for r in df.select(F.col(f"`{c}`").cast("string").alias("v")).dropna().distinct().orderBy("v").collect()]  # a row a value
        return cls(dictionaries, numeric, types)

    def sizes(self) -> dict[str, int]:
        """Codes of each column, the last for missing values."""
        return {c: self.numeric[c].size if c in self.numeric else len(self.dictionaries[c]) + 1 for c in self.types}

    def encode(self, df: DataFrame) -> DataFrame:
        code = lambda c: self.numeric[c].encode(F.col(f"`{c}`").cast("string")) if c in self.numeric else E.encode_category(F.col(f"`{c}`").cast("string"), self.dictionaries[c])
        return df.select(*[code(c).cast("int").alias(c) for c in self.types])

    def decode(self, codes: DataFrame, id_column: str, seed: str) -> DataFrame:
        out = []
        for c, t in self.types.items():
            if c in self.numeric:
                value = self.numeric[c].decode(F.col(f"`{c}`"), hash_uniform(seed, f"{c}|decode", F.col(id_column)), t not in ("float", "double") and not t.startswith("decimal"))
            else:
                value = E.decode_category(F.col(f"`{c}`"), self.dictionaries[c])
            out.append(value.cast(t).alias(c))
        return codes.select(id_column, *out)


@dataclass
class ClusteredEngine:
    """Parents judged through clusters of their codes, sparse tables of the observed cells. Domains are learned from the rows, so what the schema adds
    is the number of bins (the median of its own), the types of fit and output, and the report says so."""

    epsilon: float | None = 1.0
    bins: int | None = None
    most_parents: int = 0
    target: float = 5.0
    noise: SecureNoise = field(default_factory=SecureNoise)

    def fit(self, df: DataFrame, schema: Schema | None = None) -> "ClusteredEngine":
        self.schema = schema
        declared = sorted(schema.bins[c] for c, k in schema.kinds.items() if k in ("integer", "continuous") and c in schema.bins) if schema else []
        middle = declared[(len(declared) - 1) // 2 : len(declared) // 2 + 1]
        self.source = "constructor" if self.bins else "schema median" if declared else "default"
        self.used_bins = max(2, self.bins or (int(sum(middle) / len(middle)) if middle else 100))
        if schema:
            kinds = {c: k for c, k in schema.kinds.items() if c in df.columns}
            df = df.select(*[E.for_network(F.col(f"`{c}`"), k, schema.categories.get(c, [])).alias(c) for c, k in kinds.items()])
        self.codec = LearnedCodec.learn(df, self.used_bins)
        coded = self.codec.encode(df).persist()
        try:
            self.net = C.fit(coded, self.codec.sizes(), self.epsilon, self.most_parents, self.used_bins, self.target, noise=self.noise)
        finally:
            coded.unpersist()
        return self

    def sample(self, spark: SparkSession, n: int, seed: str = "sample") -> DataFrame:
        rows = spark.range(n).withColumnRenamed("id", "__id")
        out = self.codec.decode(self.net.sample(rows, "__id", seed=seed), "__id", seed).drop("__id")
        if not self.schema:
            return out
        return out.select(*[E.normalise(F.col(f"`{c}`").cast("string"), self.schema.kinds[c], *self.schema.bounds.get(c, (float("-inf"), float("inf"))), self.schema.categories.get(c, [])).alias(c) for c in out.columns])

    def report(self) -> dict:
        half = self.epsilon / 2 if self.epsilon else None
        return {"epsilon_total": self.epsilon, "epsilon_structure": half, "epsilon_cpt": half, "epsilon_metadata": 0.0, "delta": 0.0, "mechanism_structure": "exponential", "mechanism_cpt": "laplace",
                "metadata_source": "learned from the rows, not private", "undeclared": ["values and bounds of columns", "number of rows in the number of parents"], "bins": self.used_bins, "bins_source": self.source, "adjacency": "add or remove a row", "composition": "sequential"}


ENGINES = {"network": NetworkEngine, "graphical": GraphicalEngine, "clustered": ClusteredEngine}
