"""Entities and typed relations in code, found by patterns, and the classes of texts that decide how to look."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions.text import by_values, name_valid, parse_extraction, strip

# Fixed values: (type, pattern); group 1 is the name. Types and patterns count in this order.
ENTITY_PATTERNS = (
    ("class", r"(?U)(?:public\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("class", r"(?U)(?:export\s+)?(?:default\s+)?class\s+(\w+)"),
    ("class", r"(?Us)@Component\s*\n.*?class\s+(\w+)"),
    ("class", r"(?Us)@Service\s*\n.*?class\s+(\w+)"),
    ("class", r"(?Us)@RestController\s*\n.*?class\s+(\w+)"),
    ("class", r"(?Us)@Entity\s*\n.*?class\s+(\w+)"),
    ("function", r"(?U)(?:public|private|protected)\s+\w+\s+(\w+)\s*\([^)]*\)"),
    ("function", r"(?U)(?:export\s+)?(?:async\s+)?(?:function\s+)?(\w+)\s*\([^)]*\)\s*\{"),
    ("function", r"(?U)(?:def|fn)\s+(\w+)\s*\("),
    ("module", r"(?U)(?:package|namespace)\s+([\w.]+)"),
    ("module", r"""(?U)(?:module|from)\s+['"]([\w./-]+)['"]"""),
    ("api", r"""@(?:GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)\(["']([^"']+)["']"""),
    ("api", r"""(?U)(?:router\.(?:get|post|put|delete)|app\.(?:get|post|put|delete))\(['"](/[\w/{}]+)['"]"""),
    ("variable", r"""(?U)(?:const|let|var)\s+(\w+)\s*=\s*(?:require|import)\s*[( ]["']"""),
    ("variable", r"(?U)(?:private|public|protected)\s+(?:\w+\s+)?(\w+)\s*=\s*new\s+"),
)
JAVA_IMPORT = r"(?Umd)^import\s+([\w.]+(?:\.\w+)?)\s*;"
QUOTED_IMPORT = r"""(?U)(?:from\s+['"](\S+)['"]\s+import\s+(\w+)|import\s+(\w+)\s+from\s+['"](\S+)['"])"""

# What marks code, configuration and logs.
CODE_MARKS = (r"\b(?:class|interface|enum|struct|def|fn|function)\s+\w+", r"\bextends\s+\w+", r"\bimplements\s+\w+", r"@\w+\s*(?:\(|$)", r"import\s+[\w.*]+", r"public|private|protected\s+(?:class|interface|void|\w+)", r"\{[\s\S]*?\}")
CONFIG_MARKS = (r"<[a-zA-Z]+[\s/>]", r"</\w+>", r"<\w+>\s*</\w+>", r"(?:CREATE|ALTER|DROP|INSERT|UPDATE|DELETE|SELECT)\s+", r"<dependency>", r"dependency\s*\{", r"@(?:Value|ConfigurationProperties)", r"\w+[:=]\s*(?:\d+|true|false|null|\[\]|[\w./@$-]+)", r"\w+\.\w+\s*[:=]\s*\S+")
LOG_MARKS = (r"\A\d{4}-\d{2}-\d{2}[ T]", r"\A(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\s", r"\A\s*at\s+[\w.]+\(")


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def entities(df: DataFrame, key: str, text: str, min_len: int = 2) -> DataFrame:
    """(key, ord, name, type): each name of a text once, with the type that comes first; reserved words are left out."""

    def placed(n: int, kind: str):
        return lambda x, i: F.struct((F.lit(n * 1_000_000) + i).cast("long").alias("ord"), x.alias("name"), F.lit(kind).alias("type"))

    found = F.array(*(F.transform(every(F.col(text), p), placed(n, t)) for n, (t, p) in enumerate(ENTITY_PATTERNS)))
    rows = df.select(key, F.explode(F.flatten(found)).alias("e")).select(key, "e.*")
    rows = rows.filter((F.length("name") >= min_len) & ~F.lower("name").isin(*schema.RESERVED))
    return rows.groupBy(key, "name").agg(F.min(F.struct("ord", "type")).alias("first")).select(key, "first.ord", "name", "first.type")


def imports(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, type) of imports, repeats included: classes of Java paths with their package, quoted modules with a name."""
    path = F.split("path", r"\.")
    java = df.select(key, F.explode(every(F.col(text), JAVA_IMPORT)).alias("path"))
    classes = java.select(key, F.explode(F.filter(path, lambda p: p.rlike("^[A-Z]"))).alias("name"), F.lit("class").alias("type"))
    modules = java.filter(F.size(path) >= 2).select(key, F.element_at(path, -2).alias("name"), F.lit("module").alias("type"))
    groups = F.arrays_zip(*(every(F.col(text), QUOTED_IMPORT, g).alias(f"g{g}") for g in (1, 2, 3, 4)))
    quoted = df.select(key, F.explode(groups).alias("g"))
    pick = lambda a, b: F.coalesce(F.nullif(F.col(f"g.g{a}"), F.lit("")), F.nullif(F.col(f"g.g{b}"), F.lit("")))
    module, name = F.element_at(F.split(pick(1, 4), "/"), -1), pick(2, 3)
    sources = quoted.select(key, module.alias("name"), F.lit("module").alias("type"))
    names = quoted.select(key, name.alias("name"), F.when(name.rlike("^[A-Z]"), "class").otherwise("function").alias("type"))
    return classes.unionByName(modules).unionByName(sources).unionByName(names).filter("name is not null and name <> ''")


def doc_like(text: Column) -> Column:
    """A markdown heading, or two paragraph lines."""
    rows = F.split(strip(text), "\n", -1)
    heads = F.exists(rows, lambda x: x.rlike(r"\A#{1,6}\s"))
    cjk = F.size(F.filter(rows, lambda x: (F.length(x) > 60) & x.rlike(r"[一-鿿]")))
    latin = F.size(F.filter(rows, lambda x: (F.length(x) > 80) & x.rlike("[a-zA-Z]{3,}") & ~x.rlike(r"[{}().*]")))
    return heads | (cjk + latin >= 2)


def marks(text: Column, patterns: tuple[str, ...], flags: str = "(?iuU)") -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(flags + p).cast("int")
    return out


def classify(text: Column, ext: Column) -> Column:
    """code, config, docs, log or skip: by extension where that decides, else by the text's marks."""
    rows = F.split(strip(text), "\n", -1)
    logs = F.size(F.filter(rows, lambda x: x.rlike(LOG_MARKS[0]) | x.rlike(LOG_MARKS[1]) | x.rlike(LOG_MARKS[2])))
    e = F.lower(F.coalesce(ext, F.lit("")))
    code, config = marks(text, CODE_MARKS), marks(text, CONFIG_MARKS)
    by_ext = by_values(e, {k: schema.CLASS_EXTENSIONS[k] for k in ("skip", "code", "log")}, F.lit(None).cast("string"))
    by_text = F.when(strip(F.coalesce(text, F.lit(""))) == "", "skip").when(logs * 2 > F.size(rows), "log").when(code >= 3, "code").when(config >= 1, "config")
    return F.coalesce(by_ext, by_text, F.when(e.isin(*schema.CLASS_EXTENSIONS["docs"]) | doc_like(text), "docs").when(code >= 1, "code").otherwise("docs"))


def mode_for(kind: Column, default: str = "hybrid-7b") -> Column:
    return F.when(kind == "code", "regex").when(kind == "config", "1.5b").when(kind == "docs", default).otherwise("")


def resolve_mode(mode: str | None, use_llm: bool = False, model: str = "", enabled: bool = True) -> str:
    """The extraction mode that settings ask for; empty if extraction is off."""
    if not enabled:
        return ""
    if mode in schema.MERGE_WEIGHTS:
        return mode
    return "regex" if not use_llm else "hybrid-7b" if "7b" in model else "hybrid-1.5b"


def from_answers(df: DataFrame, key: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """Entities (key, ord, name, type) and relations of a model's answers; invalid names and variables are left out."""
    parsed = df.select(key, parse_extraction(F.col(raw)).alias("x"))
    found = parsed.select(key, F.posexplode("x.entities").alias("ord", "e")).select(key, "ord", strip(F.col("e.name")).alias("name"), F.coalesce("e.type", F.lit("concept")).alias("type"))
    relations = parsed.select(key, F.explode("x.relations").alias("r")).select(key, "r.*").filter("source is not null and target is not null")
    return found.filter(name_valid(F.col("name")) & (F.col("type") != "variable")), relations


def hybrid(regex: DataFrame, llm: DataFrame, key: str) -> DataFrame:
    """What patterns found, and of the model's names those that patterns did not, if concepts or APIs."""
    more = llm.filter(F.col("type").isin("concept", "api")).join(regex.select(key, "name"), [key, "name"], "left_anti")
    return regex.select(key, "name", "type").unionByName(more.select(key, "name", "type"))


def merge_first(results: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Keeps the first row of each key."""
    return results.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


# relations


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern as relations: source and target are made of its groups."""

    kinds: tuple[str, ...]
    pattern: str
    groups: int
    relation: str
    weight: float


JAVA, FRONTEND, PYTHON, XML, YAML = (".java",), (".vue", ".ts", ".tsx", ".js", ".jsx"), (".py",), (".xml", ".pom"), (".yaml", ".yml")
# The patterns of relations.
RULES = {
    "extends": Rule(JAVA, r"(?Us)(?:class|interface|abstract class)\s+(\w+)\s+extends\s+([\w.,\s<>{},()]+?)(?:\s+implements|\s*\{|\s*$)", 2, "extends", 1.0),
    "implements": Rule(JAVA, r"(?Us)(?:class|abstract class)\s+(\w+)(?:\s+extends\s+\w+)?\s+implements\s+([\w.,\s<>{},()]+?)\s*\{", 2, "implements", 1.0),
    "injected": Rule(JAVA, r"(?U)@(?:Autowired|Inject|Resource)\s*\n?\s*(?:private|public|protected)\s+(\w+)\s+(\w+)", 2, "depends_on", 1.0),
    "class_path": Rule(JAVA, r"""(?U)@(?:RequestMapping|RestController)\s*\(\s*(?:"([^"]+)"|'(?:[^']+)')\s*\)""", 1, "", 0.0),
    "method_path": Rule(JAVA, r"""(?U)@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\s*\(\s*(?:"([^"]+)"|'(?:[^']+)')\s*\)""", 2, "serves_path", 1.0),
    "method": Rule(JAVA, r"(?Us)@(?:Get|Post|Put|Delete|Patch|Request)Mapping.*?\n(?:public|private|protected)?\s*(?:\w+\s+)?(\w+)\s*\(", 1, "serves_path", 0.8),
    "stereotype": Rule(JAVA, r"(?U)@(Service|Component|Repository|Controller|RestController|Configuration)\s*\n?\s*(?:public\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)", 2, "is_a", 0.9),
    "field": Rule(JAVA, r"(?U)(?:private|public|protected)\s+(\w+(?:<[^>]+>)?)\s+(\w+)\s*[=;]", 2, "has_field", 0.7),
    "java_import": Rule(JAVA, JAVA_IMPORT, 1, "imports", 0.6),
    "frontend_import": Rule(FRONTEND, r"""(?U)(?:import\s+(?:\w+\s*,?\s*)?\s*\{?\s*(\w+)|\}?\s*from\s+['"]([^'"]+)['"])""", 2, "imports", 0.5),
    "python_import": Rule(PYTHON, r"(?U)(?:from\s+(\S+)\s+import\s+(\w+)|import\s+(\w+))", 3, "imports", 0.5),
    "dependency": Rule(XML, r"(?s)<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>", 2, "depends_on", 0.8),
    "reference": Rule(YAML, r"(?U)\$\{(\w+(?:\.\w+)+)\}", 1, "configures", 0.4),
}


def relations(df: DataFrame, key: str, text: str, ext: str) -> DataFrame:
    """(key, source, target, type, weight): typed edges that a chunk's text states, by the kind of its file."""
    t, e = F.col(text), F.lower(F.coalesce(F.col(ext), F.lit("")))
    upper = lambda c: c.rlike(r"(?U)^\p{Lu}")
    bare = lambda c: strip(F.regexp_replace(c, "<[^>]+>", ""))

    def matches(name: str) -> DataFrame:
        r = RULES[name]
        zipped = F.arrays_zip(*(every(t, r.pattern, g + 1).alias(f"g{g + 1}") for g in range(r.groups)))
        fits = e.isin(*r.kinds) | (e.contains(".pom") if r.kinds == XML else F.lit(False))
        return df.filter(fits).select(key, text, F.posexplode(zipped).alias("place", "g")).select(key, text, "place", "g.*")

    def rows(found: DataFrame, name: str, source: Column, target: Column, weight: float | None = None, once: bool = False) -> DataFrame:
        r = RULES[name]
        out = found.select(key, source.alias("source"), target.alias("target"), F.lit(r.relation).alias("type"), F.lit(r.weight if weight is None else weight).alias("weight"))
        return out.distinct() if once else out

    g = {i: F.col(f"g{i}") for i in (1, 2, 3)}
    base = F.coalesce(F.try_element_at(every(t, RULES["class_path"].pattern), F.lit(-1)), F.lit(""))
    out = []
    for name in ("extends", "implements"):
        split = matches(name).select(key, "g1", F.explode(F.split(strip(g[2]), r"(?U)\s*,\s*", -1)).alias("g2")).withColumn("g2", bare(g[2]))
        out.append(rows(split.filter(upper(g[2])), name, g[1], g[2]))
    out.append(rows(matches("injected").filter(upper(g[1])), "injected", g[1], g[2]))
    full = F.concat(base, g[2])
    out.append(rows(matches("method_path").filter(full != ""), "method_path", full, F.upper(F.replace(g[1], F.lit("Mapping"), F.lit("")))))
    out.append(rows(matches("method"), "method", g[1], F.when(base == "", "/").otherwise(base)))
    out.append(rows(matches("stereotype"), "stereotype", g[2], F.lower(g[1])))
    typed = matches("field").withColumn("g1", bare(g[1]))
    out.append(rows(typed.filter(upper(g[1]) & ~F.lower(g[1]).isin(*schema.FIELD_TYPES)), "field", g[1], g[2], once=True))
    path = matches("java_import").withColumn("p", F.split(g[1], r"\."))
    named = path.select(key, "place", F.try_element_at(F.filter("p", upper), F.lit(-1)).alias("s"), F.coalesce(F.try_element_at("p", F.lit(-2)), F.lit("")).alias("t")).filter("s is not null")
    out.append(rows(merge_first(named, ["place"], [key, "s"]), "java_import", F.col("s"), F.col("t")))
    found = matches("frontend_import").withColumn("n", F.coalesce(F.nullif(g[1], F.lit("")), g[2]))
    found = found.withColumn("n", F.element_at(F.split(F.element_at(F.split(strip(F.col("n")), "/"), -1), r"\."), 1))
    out.append(rows(found.filter("n <> ''"), "frontend_import", F.col("n"), F.lit(""), once=True))
    found = matches("python_import").withColumns({"n": F.coalesce(F.nullif(g[2], F.lit("")), g[3]), "m": F.coalesce(F.nullif(g[1], F.lit("")), g[3])})
    out.append(rows(merge_first(found, ["place"], [key, "n"]), "python_import", F.col("n"), F.col("m")))
    found = matches("dependency").withColumns({"g1": strip(g[1]), "g2": strip(g[2])})
    out.append(rows(merge_first(found, ["place"], [key, "g2"]), "dependency", g[2], g[1]))
    out.append(rows(matches("reference"), "reference", g[1], F.lit("config")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result
