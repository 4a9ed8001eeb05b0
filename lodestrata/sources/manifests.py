"""Dependency manifests as relations: (manifest, content) to (ecosystem, name, version, manifest).

Line formats are read with built-in functions, JSON with from_json. TOML has no reader
in Spark; its files go through the standard library's, a batch at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOSE = r"^[~^><=\s]+"


def _lines(files: DataFrame) -> DataFrame:
    return files.select("manifest", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text")).withColumn("text", F.btrim("text", F.lit(" \t\r")))


def _rows(df: DataFrame, ecosystem: str, name: Column, version: Column) -> DataFrame:
    x = df.select(F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), "manifest")
    return x.where((F.col("name") != "") & (F.col("version") != ""))


def go_mod(files: DataFrame) -> DataFrame:
    """Requirements, single or in a block; other directives are left alone."""
    x = _lines(files)
    block = F.last(F.when(F.col("text").rlike(r"^[a-z]+\s*\($"), F.regexp_extract("text", r"^([a-z]+)", 1)).when(F.col("text") == ")", ""), ignorenulls=True)
    from pyspark.sql import Window

    x = x.withColumn("block", block.over(Window.partitionBy("manifest").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    spec = F.when(F.col("text").startswith("require "), F.regexp_replace("text", r"^require\s+", "")).when(F.col("block") == "require", F.col("text"))
    pattern = r"^([^\s()]+)\s+(v[^\s/]+)"
    return _rows(x.withColumn("spec", spec), "Go", F.regexp_extract("spec", pattern, 1), F.regexp_extract("spec", pattern, 2))


def go_replaces(files: DataFrame) -> DataFrame:
    """Replacements by local paths: name, target."""
    pattern = r"^(?:replace\s+)?(\S+)(?:\s+v\S+)?\s+=>\s+((?:\.{1,2}/|/)\S*)"
    x = _lines(files)
    return x.where(F.col("text").rlike(pattern)).select("manifest", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("target"), F.lit(0.5).alias("confidence"))


def requirements(files: DataFrame) -> DataFrame:
    """The first requirement of each line, without extras and markers."""
    x = _lines(files).withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("text", r"\s*[;#].*$", ""), r"\[[^\]]*\]", "")))
    pattern = r"^([A-Za-z0-9._-]+)\s*(?:~=|==|>=|<=|!=|>|<)\s*([^,\s]+)"
    return _rows(x, "PyPI", F.lower(F.regexp_extract("text", pattern, 1)), F.regexp_extract("text", pattern, 2))


def _map_rows(files: DataFrame, ecosystem: str, fields: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f}` map<string, string>" for f in fields)
    parsed = files.select("manifest", F.from_json("content", schema).alias("j"))
    maps = F.map_concat(*[F.coalesce(F.col(f"j.`{f}`"), F.create_map().cast("map<string,string>")) for f in fields[:1]])
    out = None
    for f in fields:
        one = parsed.select("manifest", F.explode(F.coalesce(F.col(f"j.`{f}`"), maps)).alias("name", "spec")) if f == fields[0] else parsed.where(F.col(f"j.`{f}`").isNotNull()).select("manifest", F.explode(F.col(f"j.`{f}`")).alias("name", "spec"))
        out = one if out is None else out.union(one)
    version = F.trim(F.regexp_replace(F.split(F.split("spec", r"\|\|")[0], r"\s+-\s+|,")[0], LOOSE, ""))
    return out.withColumn("version", F.split(version, " ")[0]).where(F.col("version").rlike(r"^v?\d"))


def package_json(files: DataFrame) -> DataFrame:
    x = _map_rows(files, "npm", ["dependencies", "devDependencies"])
    return _rows(x, "npm", F.col("name"), F.col("version"))


def package_lock(files: DataFrame) -> DataFrame:
    parsed = files.select("manifest", F.explode(F.from_json("content", "packages map<string, struct<version: string>>")["packages"]).alias("path", "p"))
    return _rows(parsed.where(F.col("path").contains("node_modules/")), "npm", F.regexp_extract("path", r".*node_modules/(.+)$", 1), F.coalesce("p.version", F.lit(""))).dropDuplicates(["name", "version", "manifest"])


def composer(files: DataFrame) -> DataFrame:
    x = _map_rows(files, "Packagist", ["require", "require-dev"]).where(~F.col("name").rlike(r"^(?:php$|ext-|lib-)") & ~F.col("spec").startswith("dev-"))
    return _rows(x, "Packagist", F.col("name"), F.col("version"))


def pom(files: DataFrame) -> DataFrame:
    """Dependencies but those of test scope; properties are filled in once, unresolved versions dropped."""
    xml = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    deps = F.regexp_extract_all(xml, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    props = F.regexp_extract(xml, r"(?s)<properties>(.*?)</properties>", 1)
    x = files.select("manifest", props.alias("props"), F.explode(deps).alias("d"))
    tag = lambda t: F.trim(F.regexp_extract("d", rf"(?s)<{t}>(.*?)</{t}>", 1))
    x = x.select("manifest", "props", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), tag("version").alias("raw"), tag("scope").alias("scope")).where("scope <> 'test'")
    key = F.regexp_extract("raw", r"^\$\{([^}]+)\}$", 1)
    names = F.regexp_extract_all("props", F.lit(r"(?s)<([A-Za-z0-9._-]+)>([^<]*)</"), F.lit(1))
    values = F.regexp_extract_all("props", F.lit(r"(?s)<([A-Za-z0-9._-]+)>([^<]*)</"), F.lit(2))
    value = F.get(values, (F.array_position(names, F.col("key")) - 1).cast("int"))
    version = F.when(F.col("key") == "", F.col("raw")).otherwise(F.trim(F.coalesce(value, F.lit(""))))
    return _rows(x.withColumn("key", key), "Maven", F.col("name"), version).dropDuplicates(["name", "manifest"])


def gradle(files: DataFrame) -> DataFrame:
    """String and map notation of configurations that aren't for tests."""
    x = _lines(files).where(~F.col("text").rlike(r"^(?://|test)") & F.col("text").rlike(r"(?i)^(?:api|implementation|compile|compileOnly|runtimeOnly|runtime|annotationProcessor|kapt|classpath)\b"))
    s = r"[\"']([^:\"']+):([^:\"']+):([^:\"'@]+)"
    m = r"group\s*[:=]\s*[\"']([^\"']+)[\"'].*name\s*[:=]\s*[\"']([^\"']+)[\"'].*version\s*[:=]\s*[\"']([^\"']+)[\"']"
    part = lambda k: F.when(F.col("text").rlike(s), F.regexp_extract("text", s, k)).otherwise(F.regexp_extract("text", m, k))
    return _rows(x, "Maven", F.concat_ws(":", part(1), part(2)), part(3)).where("name <> ':'")


def csproj(files: DataFrame) -> DataFrame:
    refs = F.regexp_extract_all("content", F.lit(r"(?s)(<PackageReference\b[^>]*?(?:/>|>.*?</PackageReference>))"), F.lit(1))
    x = files.select("manifest", F.explode(refs).alias("r"))
    version = F.coalesce(F.nullif(F.regexp_extract("r", r'\bVersion="([^"]+)"', 1), F.lit("")), F.regexp_extract("r", r"(?s)<Version>(.*?)</Version>", 1))
    return _rows(x, "NuGet", F.regexp_extract("r", r'\bInclude="([^"]+)"', 1), F.trim(version)).dropDuplicates(["name", "manifest"])


def cargo(files: DataFrame) -> DataFrame:
    """[dependencies] without those from paths or repositories."""

    def run(frames):
        import tomllib

        import pandas as pd

        for f in frames:
            rows = []
            for m, c in zip(f["manifest"], f["content"], strict=True):
                try:
                    deps = tomllib.loads(c or "").get("dependencies", {})
                except tomllib.TOMLDecodeError:
                    continue
                for name, spec in deps.items():
                    if isinstance(spec, dict):
                        spec = "" if "path" in spec or "git" in spec else spec.get("version", "")
                    if version := str(spec).split(",")[0].lstrip("^~>=< ").strip():
                        rows.append(("crates.io", name, version, m))
            yield pd.DataFrame(rows, columns=["ecosystem", "name", "version", "manifest"])

    return files.select("manifest", "content").mapInPandas(run, "ecosystem string, name string, version string, manifest string")


def mix_exs(files: DataFrame) -> DataFrame:
    pattern = r"\{:([a-z0-9_]+),\s*\"[~>=<\s]*([0-9][^\"\s]*)\""
    x = _lines(files).where(~F.col("text").rlike(r"\b(?:path|git):"))
    return _rows(x, "Hex", F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2))


def build_sbt(files: DataFrame) -> DataFrame:
    pattern = r"\"([^\"]+)\"\s*(%%?)\s*\"([^\"]+)\"\s*%\s*\"([^\"]+)\""
    x = _lines(files)
    name = F.concat(F.regexp_extract("text", pattern, 1), F.lit(":"), F.regexp_extract("text", pattern, 3), F.when(F.regexp_extract("text", pattern, 2) == "%%", "_2.13").otherwise(""))
    return _rows(x, "Maven", name, F.regexp_extract("text", pattern, 4)).where("name <> ':'")


def package_swift(files: DataFrame) -> DataFrame:
    pattern = r"\.package\([^)]*url:\s*\"([^\"]+?)(?:\.git)?\"[^)]*?(?:from:|exact:|\.exact\(|\.upToNextMajor\(from:|\.upToNextMinor\(from:|,)\s*\"([0-9][^\"]*)\""
    x = files.select("manifest", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(\.package\(.*?\"[0-9][^\"]*\")"), F.lit(1))).alias("text"))
    return _rows(x, "SwiftURL", F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2))


READERS = {"go.mod": go_mod, "requirements.txt": requirements, "package.json": package_json, "package-lock.json": package_lock, "composer.json": composer, "pom.xml": pom, "build.gradle": gradle, "build.gradle.kts": gradle, "*.csproj": csproj, "Cargo.toml": cargo, "mix.exs": mix_exs, "build.sbt": build_sbt, "Package.swift": package_swift}
