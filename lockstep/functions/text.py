"""Scalar functions over paths, URLs, versions and commit texts, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that do not make a release another one.
PLAIN_SUFFIXES = ("jre", "android", "ga", "final")
# Words of a path that carry no concept.
STOPWORDS = (
    "test", "tests", "spec", "specs", "main", "index", "util", "utils", "common", "base", "core", "impl", "internal", "public", "private", "config", "types", "type",
    "data", "file", "files", "code", "java", "class", "interface", "string", "value", "result", "error", "context",
)
# What is cut off a name at either end, in this order.
AFFIXES = ("test", "test", "spec", "spec", "test", "spec", "impl", "test", "spec")
# The trailers that count as facts.
TRAILERS = ("change-id", "co-authored-by", "signed-off-by", "reviewed-on", "fixes")
# The patterns of versions, bounds, pins, tags, issue keys and pull requests.
VERSION_AT_END = r"([0-9]+(?:[._][0-9]+)*)([-+._]?[A-Za-z][0-9A-Za-z.+-]*)?$"
BOUND = r"(>=|<=|==|>|<|\^|~>|~|=)?\s*([0-9][0-9A-Za-z.+-]*)"
WILDCARD_TAIL = r"[.\-][*xX]$"
EXACT = r"^={2,3}\s*([^,;\s]+)$"
PSEUDO = r"[-.][0-9]{14}-([0-9a-f]{12})$"
SHA = r"\b([0-9a-f]{40}|[0-9a-f]{12})\b"
TAG = r"^v?[0-9]+(?:\.[0-9]+)*(?:[-+][0-9A-Za-z.-]+)?$"
ISSUE_KEY = r"\b([A-Z][A-Z0-9]{1,9}-[0-9]+)\b"
PR_REF = r"\(#([0-9]+)\)"
# Hosts with an API of their own, and the path parts that end a repository's address.
KNOWN_HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}
DEEP_LINKS = (
    "-", "actions", "blob", "branch", "branches", "commit", "commits", "compare", "downloads", "graphs", "issues", "merge_requests", "pull", "pull-requests", "pulls",
    "releases", "settings", "src", "tags", "tree", "wiki",
)
_LINES = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(_trim(F.coalesce(text, F.lit(""))), "^[\"']+|[\"']+$", "")


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalised(path: Column) -> Column:
    """Without outer blanks and a leading ./"""
    return F.regexp_replace(_trim(path), r"^\./", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Lower case, at most 20 characters; empty for a name whose only dots lead it."""
    found = F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*\.([^.]+)$", 1))
    return F.when(F.length(found) <= 20, found).otherwise("")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def module_path(path: Column) -> Column:
    """Without any leading run of ./ and /."""
    return F.regexp_replace(path, r"^(\./|/)+", "")


def stem(path: Column) -> Column:
    """The lower-cased name before its first dot, without test affixes at either end."""

    def cut(name: Column, affix: Column) -> Column:
        front = F.when(F.startswith(name, affix) & (F.length(name) > F.length(affix)), F.substring(name, F.length(affix) + 1, F.length(name))).otherwise(name)
        return F.when(F.endswith(front, affix) & (F.length(front) > F.length(affix)), F.substring(front, F.lit(1), F.length(front) - F.length(affix))).otherwise(front)

    name = F.aggregate(F.array(*map(F.lit, AFFIXES)), F.lower(F.substring_index(basename(path), ".", 1)), cut)
    return F.regexp_replace(name, "^[._-]+|[._-]+$", "")


def concept_tokens(path: Column) -> Column:
    """Sorted distinct words of four letters or more of the name, camel and snake case split, without stopwords."""
    words = F.regexp_extract_all(F.substring_index(basename(path), ".", 1), F.lit("[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+"), F.lit(0))
    long_ = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))
    return F.array_sort(F.array_distinct(long_))


def version_key(text: Column) -> Column:
    """The trailing version: numbers without leading and trailing zeros, then a suffix that makes a difference; null without one."""
    raw = _unquoted(text)
    found, suffix = F.regexp_extract(raw, VERSION_AT_END, 1), F.lower(F.regexp_replace(F.regexp_extract(raw, VERSION_AT_END, 2), "^[-+._]+", ""))
    numbers = F.array_join(F.transform(F.split(found, "[._]"), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")), ".")
    numbers = F.regexp_replace(numbers, r"(\.0)+$", "")
    return F.when(found != "", F.when((suffix == "") | suffix.isin(*PLAIN_SUFFIXES), numbers).otherwise(F.concat(numbers, F.lit("-"), suffix)))


def bounds(text: Column) -> tuple[Column, Column]:
    """The first version of a range that is no ceiling, and the first ceiling (< or <=); nulls where there is none."""
    raw = _unquoted(text)
    found = F.zip_with(F.regexp_extract_all(raw, F.lit(BOUND), F.lit(1)), F.regexp_extract_all(raw, F.lit(BOUND), F.lit(2)), lambda c, v: F.struct(c.alias("sign"), v.alias("v")))
    below = lambda x: F.coalesce(x["sign"], F.lit("")).isin("<", "<=")
    first = lambda rows: F.regexp_replace(F.regexp_replace(F.get(rows, F.lit(0))["v"], WILDCARD_TAIL, ""), r"\.+$", "")
    return first(F.filter(found, lambda x: ~below(x))), first(F.filter(found, below))


def classify(text: Column) -> tuple[Column, Column]:
    """(kind, sha) of a dependency's version string: commit with its sha, tag or range."""
    raw = _unquoted(text)
    raw = F.coalesce(_or_null(F.regexp_extract(raw, EXACT, 1)), raw)
    tag, pseudo, bare = raw.rlike(TAG), F.regexp_extract(raw, PSEUDO, 1), F.regexp_extract(raw, SHA, 1)
    sha = F.when(pseudo != "", pseudo).when((bare != "") & ~tag, bare)
    return F.when(sha.isNotNull(), "commit").when(tag, "tag").otherwise("range"), sha


def ordinal(key: Column) -> Column:
    """The numbers of a version key as an array, which compares as releases do; null for keys with a suffix."""
    return F.when(key.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(key, r"\."), lambda x: x.cast("decimal(20,0)")))


def repo_ref(name: Column) -> tuple[Column, Column]:
    """(owner, name) that a dependency's name speaks of, lower case; owner is null for a bare name."""
    text = F.regexp_replace(F.regexp_replace(_unquoted(name), "/+$", ""), "^@+", "")
    text = F.when(text.contains("://"), F.regexp_replace(text, "^(?s:.*?)://", "")).otherwise(text)
    text = F.regexp_replace(F.substring_index(text, "#", 1), r"\.git$", "")
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & ~p.rlike("^v[0-9]+$"))
    return F.lower(F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))), F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))


def issue_keys(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit(ISSUE_KEY), F.lit(1)))


def pr_refs(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit(PR_REF), F.lit(1)))


def trailers(body: Column) -> Column:
    """`name: value` of the trailer lines that count, names in lower case, cut to 300 characters, each once in order."""
    told = F.transform(F.split(body, _LINES), lambda x: F.struct(F.lower(_trim(F.substring_index(x, ":", 1))).alias("name"), _trim(F.regexp_replace(x, "^[^:]*:?", "")).alias("value"), x.contains(":").alias("has")))
    kept = F.filter(told, lambda x: x["has"] & x["name"].isin(*TRAILERS) & (x["value"] != ""))
    return F.array_distinct(F.transform(kept, lambda x: F.substring(F.concat_ws(": ", x["name"], x["value"]), 1, 300)))


def facts(subject: Column, body: Column) -> Column:
    """(kind, key) of all that a commit states, in order: issue keys and pull requests of the subject, trailers of the body."""
    of = lambda kind, keys: F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    return F.concat(of("issue_key", issue_keys(subject)), of("pr_ref", pr_refs(subject)), of("trailer", trailers(body)))


def fingerprint(*parts: Column) -> Column:
    """The first 32 hex digits of a SHA-256 over the parts, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def source_url(url: Column) -> dict[str, Column]:
    """scheme, host, path, query and fragment of a URL."""
    part = lambda k: F.regexp_extract(url, r"^([a-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    return {"scheme": part(1), "host": part(2), "path": part(3), "query": part(4), "fragment": part(5)}


def repository_url(raw: Column) -> dict[str, Column]:
    """provider, host, owner, repo, web_url and clone_url of a pasted address; all null for one that names no owner.

    git@host:owner/repo and bare owner/repo are read as well; a bare name stands for the first of KNOWN_HOSTS. Links
    deeper than the repository are cut back to it; gitlab owners may be nested.
    """
    text = _trim(F.coalesce(raw, F.lit("")))
    ssh = r"^(?:ssh://)?[\w.-]+@([\w.-]+):(.+)$"
    bare = F.regexp_replace(text, "^/+|/+$", "")
    url = F.when(text.rlike(ssh) & ~text.contains("//"), F.concat(F.lit("https://"), F.regexp_extract(text, ssh, 1), F.lit("/"), F.regexp_extract(text, ssh, 2)))
    url = url.when(text.contains("://"), text).when(bare.rlike(r"^[\w.-]+(/[\w.-]+)?$"), F.concat(F.lit(f"https://{next(iter(KNOWN_HOSTS))}/"), bare))
    place = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)"
    host, port = F.lower(F.regexp_extract(url, place, 1)), F.regexp_extract(url, place, 2)
    parts = F.filter(F.split(F.regexp_extract(url, place, 3), "/"), lambda p: p != "")
    deep = F.filter(F.transform(parts, lambda p, i: F.when((i >= 2) & p.isin(*DEEP_LINKS), i)), lambda i: i.isNotNull())
    parts = F.when(F.size(deep) > 0, F.slice(parts, F.lit(1), F.array_min(deep))).otherwise(parts)
    provider = F.lit("git")
    for known, name in KNOWN_HOSTS.items():
        provider = F.when(host == known, name).otherwise(provider)
    nested = (provider == "gitlab") & (F.size(parts) > 2)
    owner = F.when(nested, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(F.get(parts, F.lit(0)))
    repo = F.regexp_replace(F.when(nested, F.try_element_at(parts, F.lit(-1))).otherwise(F.get(parts, F.lit(1))), r"\.git$", "")
    web = F.concat(F.lit("https://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.lit("/"), owner, F.coalesce(F.concat(F.lit("/"), repo), F.lit("")))
    fine = (host != "") & (F.size(parts) > 0)
    out = {"provider": provider, "host": host, "owner": owner, "repo": repo, "web_url": web, "clone_url": F.when(repo.isNotNull(), F.concat(web, F.lit(".git"))).otherwise("")}
    return {k: F.when(fine, v) for k, v in out.items()}


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval, within [0, 1]; (0, 0) for n = 0."""
    m = F.when(n > 0, n.cast("double"))
    p = hits / m
    middle, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    clip = lambda x: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(0.0))
    return clip(middle - half), clip(middle + half)
