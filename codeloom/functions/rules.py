"""Classification rules as column expressions (JVM side; each becomes part of a scan's projection or filter)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the rule tables that results are compared with.
JDK_PACKAGES = ("java.lang.", "java.util.", "java.io.", "java.nio.", "java.net.", "java.time.", "java.sql.", "java.math.", "java.text.", "java.util.concurrent.", "java.util.stream.", "java.util.function.", "javax.servlet.", "javax.annotation.")
UTIL_PACKAGES = ("org.apache.commons.", "org.springframework.util.", "com.google.common.", "org.slf4j.", "org.apache.logging.", "lombok.", "cn.hutool.", "com.alibaba.fastjson.", "com.fasterxml.jackson.", "org.apache.http.")
DTO_SUFFIXES = ("DTO", "Dto", "VO", "Vo", "DO", "Do", "Request", "Response", "Req", "Resp", "Result")
NOISE_NAMES = ("Code", "Log", "Logger", "Constants", "BaseEntity", "BaseVO")
ENTITY_SUFFIXES = ("Entity", "Model", "PO", "Po")
UTIL_SUFFIXES = ("Utils", "Util", "Helper", "Constants", "Constant")
MODES = ("none", "loose", "moderate", "strict")


def _any(xs: list[Column]) -> Column:
    return reduce(or_, xs) if xs else F.lit(False)


def _starts(c: Column, xs: tuple[str, ...]) -> list[Column]:
    return [c.startswith(x) for x in xs]


def _ends(c: Column, xs: tuple[str, ...]) -> list[Column]:
    return [c.endswith(x) for x in xs]


def is_noise(fqn: Column, name: Column, mode: str = "moderate") -> Column:
    """Whether a class is noise; an empty or missing fqn always is."""
    if mode not in MODES:
        raise ValueError(mode)
    rules: list[Column] = []
    if mode != "none":
        rules += _starts(fqn, JDK_PACKAGES)
    if mode in ("moderate", "strict"):
        rules += _starts(fqn, UTIL_PACKAGES) + _ends(name, UTIL_SUFFIXES) + [name.isin(*NOISE_NAMES)] + _ends(name, DTO_SUFFIXES)
    if mode == "strict":
        rules += _ends(name, ENTITY_SUFFIXES)
    return F.coalesce(fqn, F.lit("")).eqNullSafe("") | F.coalesce(_any(rules), F.lit(False))


def passes_text_filter(fqn: Column, name: Column, mode: str = "moderate") -> Column:
    """The second rule table: data-object suffixes count only in strict mode, exact names never."""
    if mode == "none":
        return F.lit(True)
    rules = _starts(fqn, JDK_PACKAGES)
    if mode in ("moderate", "strict"):
        rules += _starts(fqn, UTIL_PACKAGES) + _ends(name, UTIL_SUFFIXES)
    if mode == "strict":
        rules += _ends(name, DTO_SUFFIXES) + _ends(name, ENTITY_SUFFIXES)
    return ~_any(rules)


def table_name(mapper: Column) -> Column:
    """snake_case of a mapper's name without 'Mapper': ChatroomNobleMapper -> chatroom_noble."""
    bare = F.regexp_replace(mapper, "Mapper$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def simple_name(fqn: Column) -> Column:
    return F.element_at(F.split(fqn, "\\."), -1)


def http_method(annotation: Column) -> Column:
    """The HTTP verb an annotation's name tells (the first of this order); POST if it tells none."""
    verbs = ("Post", "Get", "Put", "Delete", "Patch")
    return F.coalesce(*(F.when(annotation.contains(v), v.upper()) for v in verbs), F.lit("POST"))


def visibility(modifiers: Column) -> Column:
    out = F.lit("package")
    for v in ("private", "protected", "public"):
        out = F.when(F.array_contains(modifiers, v), v).otherwise(out)
    return out


def architecture_layer(name: Column, package: Column, annotations: Column, is_mapper: Column, is_dubbo: Column, implements: Column) -> Column:
    """The layer that the first of these rules gives: by role, then per layer by annotation before package and name."""
    has = lambda *xs: _any([F.array_contains(annotations, x) for x in xs])
    inside = lambda x: F.lower(F.coalesce(package, F.lit(""))).contains(x)
    remote = F.exists(implements, lambda i: i.contains("RemoteService"))
    rules = [
        ("Mapper", is_mapper),
        ("Controller", has("Controller", "RestController") | is_dubbo & remote),
        ("Service", has("Service") & ~is_dubbo | inside("service") & ~inside("impl")),
        ("Manager", name.endswith("Manager") | inside("manager")),
        ("DAO", has("Repository") | inside("dao")),
        ("Entity", has("Entity") | inside("entity") | inside("domain")),
        ("Helper", name.endswith("Helper") | name.endswith("Util")),
    ]
    return F.coalesce(*(F.when(cond, layer) for layer, cond in rules), F.lit("Other"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression on whole paths (* and ? stay within a name, ** crosses folders)."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"(?:^|/){out}$"


def risk(n: Column) -> Column:
    return F.when(n == 0, "none").when(n < 5, "low").when(n < 20, "medium").otherwise("high")


def git_url(url: Column) -> Column:
    """A clone URL in one form: ssh as https, no .git suffix, no slash at the end."""
    x = F.regexp_replace(F.trim(url), "^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    return F.regexp_replace(F.regexp_replace(x, "/+$", ""), "\\.git$", "")
