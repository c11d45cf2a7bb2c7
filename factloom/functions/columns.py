"""Scalar functions over facts: identities, names, paths and identifier words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: stands between the parts of an identity.
SEPARATOR = "␟"
#: Identifier words that say nothing.
STOP_WORDS = ["self", "def", "class", "return", "the", "a", "an", "and", "or", "if", "else", "in", "is", "not", "none", "to", "of", "for", "import", "from", "with", "as"]
#: Container images that are databases.
DATABASE_IMAGES = ["postgres", "mysql", "mariadb", "mongo", "neo4j"]
EMBEDDING_DIMENSION = 1024


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined by SEPARATOR; null if any part is null."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(SEPARATOR), p.cast("string"))
    return F.sha1(joined)


def repository_id(remote_url: Column, root_path: Column) -> Column:
    """By the remote where there is one (an empty one counts as none), else by the local root."""
    remote = F.nullif(remote_url, F.lit(""))
    return F.coalesce(stable_id(F.lit("repository"), remote), stable_id(F.lit("repository"), F.lit("local"), root_path))


def file_id(repository: Column, path: Column) -> Column:
    return stable_id(F.lit("file"), repository, path)


def class_id(file: Column, name: Column) -> Column:
    return stable_id(F.lit("class"), file, name)


def method_id(owner: Column, name: Column) -> Column:
    return stable_id(F.lit("method"), owner, name)


def function_id(file: Column, name: Column, line: Column) -> Column:
    return stable_id(F.lit("function"), file, name, line)


def commit_id(repository: Column, commit_hash: Column) -> Column:
    return stable_id(F.lit("commit"), repository, commit_hash)


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), name)


def api_key(method: Column, path: Column) -> Column:
    return F.concat(F.lit("api:"), F.upper(method), F.lit(" "), path)


def relationship_id(rel_type: Column, source: Column, target: Column) -> Column:
    return F.concat(rel_type, F.lit(":"), source, F.lit("->"), target)


def snapshot_id(repository: Column, revision: Column) -> Column:
    return F.concat(repository, F.lit("@"), revision)


def scenario_id(text: Column) -> Column:
    return F.concat(F.lit("SC-"), F.substring(F.sha1(text), 1, 8))


def qualified_name(owner: Column, name: Column) -> Column:
    """owner.name, or the name alone where there is no owner."""
    return F.concat_ws(".", F.nullif(owner, F.lit("")), name)


def module_name(path: Column) -> Column:
    """The dotted module of a file: a package's __init__.py stands for the package, at the root for nothing."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^__init__\.py$", ""), r"(/__init__)?\.py$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def absolute_module(path: Column, module: Column) -> Column:
    """The module that an import in the file `path` names; null where its dots lead out of the repository.

    A package's __init__.py counts as a plain module of the package above it.
    """
    rest = F.regexp_replace(module, r"^\.+", "")
    dots = F.length(module) - F.length(rest)
    own = module_name(path)
    parts = F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, r"\."))
    room = F.greatest(F.size(parts) - 1, F.lit(0)) - (dots - 1)
    base = F.slice(parts, F.lit(1), F.greatest(room, F.lit(0)))
    joined = F.array_join(F.concat(base, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest))), ".")
    return F.when(dots == 0, F.nullif(module, F.lit(""))).when(room >= 0, F.nullif(joined, F.lit("")))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$")


def location_file(location: Column) -> Column:
    return F.element_at(F.split(location, "::", 2), 1)


def location_name(location: Column) -> Column:
    """What follows the first ::, null if there is none."""
    return F.try_element_at(F.split(location, "::", 2), F.lit(2))


def path_suffixes(path: Column) -> Column:
    """The path and everything that follows one of its slashes: p ends with "/" + s, or equals s, just when s is among them."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def words(text: Column) -> Column:
    """Identifier words in lower case, without stop words and single characters: isEligible and is_eligible alike."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][a-z]*|\d+"), F.lit(0)), F.lower)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def bucket(word: Column) -> Column:
    """The word's dimension of the hashed embedding: its MD5 modulo EMBEDDING_DIMENSION."""
    return (F.conv(F.right(F.md5(word), F.lit(3)), 16, 10).cast("int") % EMBEDDING_DIMENSION).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def package_name(name: Column) -> Column:
    """One spelling for a dependency's name: runs of - _ . are one hyphen, in lower case."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def requirement(line: Column) -> Column:
    """A requirement line as (name, spec): a name, [extras], a specifier or an @ address, then a marker after ; and what is no part of it (options, a comment).

    Null for lines that begin with no name or are options, paths or bare addresses.
    """
    own = F.btrim(F.split(F.split_part(line, F.lit(" #"), F.lit(1)), r"\s+--", 2)[0], F.lit(" \t\n\r\f"))
    wanted = F.split_part(own, F.lit(";"), F.lit(1))
    name = F.regexp_extract(wanted, r"^\p{Alnum}[\w.-]*", 0)
    tail = F.ltrim(F.substr(wanted, F.length(name) + 1))
    closed = F.instr(tail, "]")
    spec = F.when(F.startswith(tail, F.lit("[")) & (closed > 0), F.substr(tail, closed + 1)).otherwise(tail)
    address = F.contains(F.split_part(own, F.lit("@"), F.lit(1)), F.lit("://"))
    return F.when((name != "") & ~address, F.struct(package_name(name).alias("name"), F.regexp_replace(spec, r"\s", "").alias("spec")))


def database_engine(image: Column) -> Column:
    """The database engine of a container image, null for other images."""
    name = F.lower(F.substring_index(F.substring_index(F.substring_index(image, "/", -1), ":", 1), "@", 1))
    return F.when(name.isin(*DATABASE_IMAGES), name)


def url_host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^https?://([^/:?#]+)", 1), F.lit("")))


def outer_json(text: Column) -> Column:
    """The text from its first { to its last }, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def new_file_patch(path: Column, text: Column) -> Column:
    """A unified diff that creates the file."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    head = F.concat(F.lit("--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n"))


def bounded_text(text: Column, limit: int) -> Column:
    """At most `limit` bytes: the first quarter and the last three, with a mark between them that says how much is left out.

    What a cut leaves of a character becomes U+FFFD.
    """
    data = F.encode(text, "UTF-8")
    head = limit // 4
    tail = limit - head
    cut = F.concat(
        F.make_valid_utf8(F.substring(data, 1, head).cast("string")),
        F.format_string("\n[... %d bytes truncated ...]\n", F.length(data) - limit),
        F.make_valid_utf8(F.substring(data, -tail, tail).cast("string")),
    )
    return F.when(F.length(data) <= limit, text).otherwise(cut)


def filled(template: Column, values: Column) -> Column:
    """The template with each {name} replaced by values[name]; an unknown name raises an error."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Za-z0-9_.-]+)\}"), F.lit(1)))
    known = lambda n: F.coalesce(F.try_element_at(values, n), F.raise_error(F.concat(F.lit("unknown placeholder "), n)).cast("string"))
    return F.aggregate(names, template, lambda t, n: F.replace(t, F.concat(F.lit("{"), n, F.lit("}")), known(n)))


def text_statistics(text: Column) -> Column:
    """(words, chars, average): words between white space, characters, characters a word (0 without words)."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    n = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))
    return F.struct(n.cast("long").alias("words"), F.length(text).cast("long").alias("chars"), F.when(n > 0, F.length(text) / n).otherwise(0.0).alias("average"))


def issue_query(*parts: Column) -> Column:
    """The texts of the parts (arrays of texts) that are not empty, joined by blanks."""
    return F.array_join(F.filter(F.concat(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def slug(text: Column) -> Column:
    """Lower case; runs of what is no ASCII letter or digit are one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def capped(values: Column, limit: int) -> Column:
    """(values, dropped): the first `limit` of an array's texts that are not blank, without blanks around them, and how many more there are."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.slice(kept, 1, limit).alias("values"), F.greatest(F.size(kept) - limit, F.lit(0)).alias("dropped"))
