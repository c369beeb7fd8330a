"""Which files are crawled, and which names are noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Formats and their size limits, file attribute bits, marker and directory names.
FORMAT_LIMITS = {".txt": 5 * 1024 * 1024, ".md": 5 * 1024 * 1024, ".markdown": 5 * 1024 * 1024, ".docx": 10 * 1024 * 1024}
HIDDEN, SYSTEM, DIRECTORY, TEMPORARY, REPARSE, OFFLINE = 0x2, 0x4, 0x10, 0x100, 0x400, 0x1000
RECALL_ON_OPEN, PINNED, UNPINNED, RECALL_ON_DATA = 0x40000, 0x80000, 0x100000, 0x400000
UNSAFE = HIDDEN | SYSTEM | REPARSE | OFFLINE | TEMPORARY | RECALL_ON_DATA
SOFT_ATTRIBUTES = HIDDEN | SYSTEM | REPARSE | OFFLINE | RECALL_ON_OPEN | PINNED | UNPINNED | RECALL_ON_DATA
REPOSITORY_MARKERS = [".git", ".hg", ".svn", ".jj"]
EXCLUDED_DIRECTORIES = [
    "$Recycle.Bin", "System Volume Information", "Recovery", "WindowsApps", "AppData", "Temp", "tmp", ".cache", "Cache", "Caches",
    "node_modules", "bower_components", "vendor", "packages", ".packages", ".nuget", ".npm", ".pnpm-store", ".yarn", ".gradle", ".m2",
    ".venv", "venv", "env", "__pycache__", ".tox", ".conda", "bin", "obj", "target", "dist", "build", "out", "artifacts",
    "Debug", "Release", ".next", ".nuxt", ".output", ".svelte-kit", ".turbo", ".vite", ".idea", ".vs", ".vscode", "coverage",
    "Installer", "Installers", "Setup",
]
HARD_COMPONENTS = ["$Recycle.Bin", "System Volume Information"]
HARD_NAMES = ["desktop.ini", "Thumbs.db", "ehthumbs.db", ".DS_Store", "pagefile.sys", "hiberfil.sys", "swapfile.sys", "DumpStack.log.tmp"]
SOFT_COMPONENTS = [
    "Windows", "Program Files", "Program Files (x86)", "ProgramData", "AppData", "Temp", "tmp", "cache", ".cache", "Caches", "CrashDumps",
    ".git", ".hg", ".svn", ".jj", "CVS", "node_modules", "bower_components", "vendor", "packages", ".packages",
    ".nuget", ".npm", ".pnpm-store", ".yarn", ".gradle", ".m2", ".venv", "venv", "env", "__pycache__", ".tox", ".conda",
    "bin", "obj", "target", "dist", "build", "out", "artifacts", "Debug", "Release", ".next", ".nuxt", ".output", ".svelte-kit",
    ".turbo", ".vite", ".idea", ".vs", ".vscode", "coverage", "coverage-reports", "Installer", "Installers", "Setup", "Package Cache",
]
SOFT_EXTENSIONS = [
    ".part", ".partial", ".crdownload", ".download", ".cache", ".bak", ".backup", ".old", ".orig", ".swp", ".swo", ".log", ".dmp", ".etl",
    ".obj", ".o", ".a", ".lib", ".dll", ".exe", ".pdb", ".ilk", ".idb", ".pch", ".class", ".jar", ".pyc", ".pyo", ".nupkg",
    ".snupkg", ".whl", ".msi", ".msix", ".appx", ".cab", ".vsix", ".map",
]
SOFT_SUFFIXES = [".min.js", ".min.css", ".deps.json", ".runtimeconfig.json"]
MAX_CHARACTERS = 1_000_000
REJECTED_PRIORITY = 2**31 - 1

#: Parameters of the machine; the defaults fit the adapters' catalog.
DRIVES = ["D:"]
PROTECTED = ["d:\\src1"]
USERS_ROOT, USER_ROOT = "d:\\src2", "d:\\src2\\docs"
PRIORITY_ROOTS = ["d:\\src3", "d:\\src4\\downloads"]
TEMPORARY_ROOTS = ["d:\\src5\\temp"]
SYSTEM_ROOTS = ["d:\\src6"]


def _any_of(parts: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.transform(parts, F.lower), F.array(*(F.lit(n) for n in sorted({n.lower() for n in names}))))


def eligible_drives(drives: DataFrame) -> DataFrame:
    """Ready fixed drives with a journaling format, by root."""
    good = drives.filter(F.col("is_ready") & (F.lower("drive_type") == "fixed") & F.upper("drive_format").isin("NTFS", "REFS"))
    return good.select("root_path", F.lower("root_path").alias("root_key")).dropDuplicates(["root_key"]).orderBy("root_key").select("root_path")


#: Ticks of 100 ns from year 1 to 1970.
EPOCH_TICKS = 621_355_968_000_000_000


def scan_markers(catalog: DataFrame) -> DataFrame:
    """Entries named like a repository marker or an excluded directory."""
    return catalog.filter(F.lower("name").isin(sorted({n.lower() for n in REPOSITORY_MARKERS + EXCLUDED_DIRECTORIES})))


def dynamic_exclusions(markers: DataFrame) -> DataFrame:
    """A repository marker excludes its parent's subtree, an excluded directory its own."""
    is_marker = F.lower("name").isin(REPOSITORY_MARKERS)
    prefix = F.when(is_marker, F.col("parent_path")).when(F.col("attributes").bitwiseAND(DIRECTORY) != 0, F.col("full_path"))
    return markers.select(F.lower(paths.trimmed(prefix)).alias("prefix")).filter("prefix <> ''").distinct()


def max_bytes(extension: Column) -> Column:
    limits = F.create_map(*(F.lit(x) for k, v in FORMAT_LIMITS.items() for x in (k, v)))
    return limits[extension]


def crawl_priority(path_key: Column, modified_at: Column, as_of: Column) -> Column:
    recent = F.coalesce(modified_at, F.timestamp_seconds(F.lit(0))) >= as_of - F.expr("INTERVAL 30 DAYS")
    return F.when(paths.within_any(path_key, PRIORITY_ROOTS), 0).when(recent, 1).otherwise(2)


def evaluate(entries: DataFrame, exclusions: DataFrame, as_of: Column, id_col: str = "doc_id") -> DataFrame:
    """One decision per entry: the first rule that fails names it.

    Subtree exclusion is an equi-join of each entry's ancestors with the excluded prefixes, reduced
    to one row per entry before it meets the catalog.
    """
    rows = entries.withColumns({"ext": paths.dotted_extension(F.col("extension"), F.col("name")), "size": F.coalesce("size", F.lit(0))})
    hit = rows.select(id_col, F.explode(paths.ancestors(F.col("path_key"))).alias("prefix")).join(exclusions, "prefix", "left_semi").select(id_col).distinct().withColumn("excluded", F.lit(True))
    limit = max_bytes(F.col("ext"))
    key = F.col("path_key")
    path = F.coalesce("full_path", F.lit(""))
    reason = (
        F.when((F.trim(path) == "") | F.contains(path, F.lit("\0")), "invalid path")
        .when(limit.isNull(), "unsupported format")
        .when((F.col("size") < 0) | (F.col("size") > limit), "file size limit")
        .when(F.col("attributes").bitwiseAND(UNSAFE) != 0, "unsafe file attributes")
        .when(~paths.within_any(key, DRIVES), "ineligible drive")
        .when(paths.within_any(key, PROTECTED), "protected path")
        .when(paths.within(key, USERS_ROOT) & ~paths.within(key, USER_ROOT), "other user profile")
        .when(_any_of(paths.directories(key), EXCLUDED_DIRECTORIES), "excluded directory")
        .when(F.coalesce("excluded", F.lit(False)), "repository or excluded subtree")
        .otherwise("accepted")
    )
    out = rows.join(hit, id_col, "left").withColumn("reason", reason)
    accepted = F.col("reason") == "accepted"
    return out.select(
        id_col, "full_path", accepted.alias("accepted"), "reason", F.coalesce(limit, F.lit(0)).cast("long").alias("max_bytes"), F.lit(MAX_CHARACTERS).alias("max_chars"),
        F.when(accepted, crawl_priority(key, F.col("modified_at"), as_of)).otherwise(REJECTED_PRIORITY).alias("priority"),
    )


def fingerprint(path: Column, size: Column, modified_at: Column, revision: int = 1) -> Column:
    """Upper-case SHA-256 of path, size, time (ticks of 100 ns since year 1) and the extractor's revision."""
    ticks = F.unix_micros(modified_at) * 10 + EPOCH_TICKS
    parts = F.concat_ws("|", F.upper(path), F.coalesce(size, F.lit(0)).cast("string"), ticks.cast("string"), F.lit(str(revision)))
    return F.upper(F.sha2(parts, 256))


def exact_query(query: Column, name: Column, path_key: Column) -> Column:
    """The query, less one pair of quotes, is the name or the full path."""
    plain = F.trim(query)
    plain = F.lower(F.when((F.length(plain) >= 2) & F.startswith(plain, F.lit('"')) & F.endswith(plain, F.lit('"')), F.trim(F.substring(plain, F.lit(2), F.length(plain) - 2))).otherwise(plain))
    return (F.lower(name) == plain) | (plain.rlike(r"^[a-z]:\\") & (paths.trimmed(plain) == path_key))


def name_match_rank(query: Column, name: Column) -> Column:
    q, n = F.lower(F.trim(query)), F.lower(name)
    return F.when(n == q, 0).when(F.startswith(n, q), 1).when(F.contains(n, q), 2).otherwise(3)


def temporary_roots(environment: dict[str, str]) -> list[str]:
    """Folders of temporary files as a machine's environment names them: each once, whatever its case."""
    below = [(environment.get("LOCALAPPDATA") or "", "Temp"), (environment.get("WINDIR") or "", "Temp")]
    named = [environment.get("TEMP"), environment.get("TMP"), *(f"{root.rstrip(chr(92))}\\{leaf}" for root, leaf in below if root.strip())]
    return list(dict.fromkeys(p.strip().replace("/", "\\").rstrip("\\").lower() for p in named if p and p.strip()))


def noise(query: Column, name: Column, path_key: Column, extension: Column, attributes: Column, temporary: list[str] | None = None) -> Column:
    """2 is filtered, 1 is ranked below, 0 is normal; an exact query lifts what is only soft. ``temporary``: folders of
    temporary files, TEMPORARY_ROOTS unless given."""
    leaf, parts = F.lower(name), paths.components(path_key)
    ext = paths.dotted_extension(extension, name)
    hard = (
        (attributes.bitwiseAND(TEMPORARY) != 0)
        | paths.within_any(path_key, TEMPORARY_ROOTS if temporary is None else temporary)
        | _any_of(parts, HARD_COMPONENTS)
        | ext.isin(".tmp", ".temp")
        | leaf.isin([".tmp", ".temp", *(n.lower() for n in HARD_NAMES)])
        | F.startswith(leaf, F.lit("~$"))
        | F.startswith(leaf, F.lit(".~lock."))
    )
    soft = (attributes.bitwiseAND(SOFT_ATTRIBUTES) != 0) | paths.within_any(path_key, SYSTEM_ROOTS) | _any_of(parts, SOFT_COMPONENTS) | F.startswith(leaf, F.lit(".tmp")) | ext.isin(SOFT_EXTENSIONS)
    for suffix in SOFT_SUFFIXES:
        soft = soft | F.endswith(leaf, F.lit(suffix))
    return F.when(hard, 2).when(exact_query(query, name, path_key), 0).when(soft, 1).otherwise(0)
