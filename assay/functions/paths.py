"""Path rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def normalized(path: Column) -> Column:
    """Without blanks around it, a file:// scheme (of which %-escapes are decoded) and leading ./"""
    p = F.trim(path)
    url = F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(p, r"^file://(localhost)?/*", "/"), F.lit("+"), F.lit("%2B"))), p)
    return F.regexp_replace(F.when(p.startswith("file://"), url).otherwise(p), r"^(\./)+", "")


def is_test(path: Column) -> Column:
    p = F.lower(path)
    name, rooted = file_name(p), F.concat(F.lit("/"), p)
    return (
        rooted.contains("/tests/") | rooted.contains("/__tests__/") | p.endswith("/__tests__") | rooted.contains("/e2e/")
        | name.startswith("test_") | name.contains(".test.") | name.contains(".spec.")
    )


def source_type(path: Column) -> Column:
    """test, runbook, incident, pr, code, doc or other; the first rule that holds."""
    p = F.lower(path)
    return (
        F.when(is_test(path), "test").when(p.contains("runbook") | p.contains("playbook"), "runbook").when(p.contains("incident") | p.contains("postmortem"), "incident")
        .when(F.concat(F.lit("/"), p).contains("/prs/") | p.contains("pull_request") | p.rlike(r"\bpr[_-]?\d+"), "pr")
        .when(suffix(path).isin(*fixed.CODE_SUFFIXES), "code").when(p.rlike(r"\.(md|rst|txt)$"), "doc").otherwise("other")
    )


def is_script(path: Column) -> Column:
    return suffix(path).isin(*fixed.SCRIPT_SUFFIXES)


def is_frontend(path: Column) -> Column:
    p = F.lower(path)
    part = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ("app", "apps", "components", "pages", "routes", "web")]))
    return is_script(path) & (suffix(path).isin(".jsx", ".tsx") | part | p.rlike("/(components|pages|routes|app|ui)/"))


def identifier_words(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)


def label(path: Column) -> Column:
    """The lower-case stem, or the folder's name where the stem is generic."""
    s, parts = F.lower(stem(path)), F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -2))).otherwise("")
    return F.when(s.isin(*fixed.GENERIC_STEMS) & (folder != ""), folder).otherwise(s)


def anchor_words(path: Column) -> Column:
    """Distinct words that name a path: of its last four parts and its stem or folder, without generic ones, sorted."""
    generic = F.array(*[F.lit(x) for x in fixed.GENERIC_PATH_WORDS])
    parts = F.split(path, "/")
    last = F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), F.lit(4))
    s = F.lower(stem(path))
    extra = F.when(s.isin(*fixed.GENERIC_STEMS) & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(stem(path))
    bare = F.filter(F.transform(F.concat(last, F.array(extra)), stem), lambda x: ~F.array_contains(generic, F.lower(x)))
    words = F.flatten(F.transform(bare, lambda x: F.concat(identifier_words(x), F.array(F.array_join(identifier_words(x), "")))))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(generic, w))))


def frontend_words(path: Column) -> Column:
    """Distinct words that name a front-end path: of its last four parts and its stem, or its folder where the stem is generic, sorted."""
    generic = F.array(*[F.lit(x) for x in fixed.FRONTEND_WORDS])
    parts = F.split(path, "/")
    last = F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), F.lit(4))
    extra = F.when(F.lower(stem(path)).isin(*fixed.FRONTEND_WORDS) & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(stem(path))
    bare = F.filter(F.transform(F.concat(last, F.array(extra)), stem), lambda x: ~F.array_contains(generic, F.lower(x)))
    words = F.flatten(F.transform(bare, lambda x: F.concat(identifier_words(x), F.array(F.array_join(identifier_words(x), "")))))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(generic, w))))


def link_score(source: Column, test: Column, source_words: Column, test_words: Column) -> Column:
    """How well a test path fits a source path, 0 to 1; the words are their anchor_words."""
    overlap = F.size(F.array_intersect(source_words, test_words))
    generic = F.array(*[F.lit(x) for x in fixed.GENERIC_PATH_WORDS])
    folders = lambda p: F.array_except(F.transform(F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1), F.lower), generic)
    shared = F.size(F.array_intersect(folders(source), folders(test)))
    named = F.array_contains(test_words, label(source)).cast("double")
    parent = F.when(F.lower(stem(source)).isin(*fixed.GENERIC_STEMS) & (F.size(F.split(source, "/")) > 1), F.array_contains(test_words, F.lower(F.element_at(F.split(source, "/"), -2))).cast("double")).otherwise(0.0)
    score = 0.25 + 0.45 * overlap / F.greatest(F.size(source_words), F.lit(1)) + 0.2 * named + F.least(F.lit(0.15), 0.05 * shared) + 0.15 * parent
    return F.when(is_test(test) & (overlap > 0), F.least(F.lit(1.0), score)).otherwise(0.0)


def module_name(path: Column) -> Column:
    """Dotted module of a Python path; a package's own file is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/?__init__$", ""), "/", ".")
