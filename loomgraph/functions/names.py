"""Functions on dotted class and package names, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PACKAGE = "[default package]"


def doted(c: Column) -> Column:
    """a/b to a.b."""
    return F.translate(c, "/", ".")


def slashed(c: Column) -> Column:
    """a.b to a/b."""
    return F.translate(c, ".", "/")


def quoted(c: Column) -> Column:
    """The name in double quotes."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def package_name(c: Column) -> Column:
    """What stands before the last dot; empty without a dot."""
    return F.regexp_extract(c, r"(?s)^(.*)\.[^.]*$", 1)


def file_name(c: Column) -> Column:
    """What stands after the last dot."""
    return F.substring_index(c, ".", -1)


def display_name(c: Column) -> Column:
    """The name as it is shown: the default package has a label."""
    return F.when(c == "", DEFAULT_PACKAGE).otherwise(c)


def is_pathological(file: Column) -> Column:
    """Whether the ``$`` in a file name don't part nested classes: at either end, or two in a row."""
    return file.startswith("$") | file.endswith("$") | file.contains("$$")


def outer_file_name(c: Column) -> Column:
    """The file name of the outer class; null for top level classes and pathological names."""
    file = file_name(c)
    return F.when(~is_pathological(file) & file.contains("$"), F.regexp_extract(file, r"(?s)^(.*)\$[^$]*$", 1))


def outer_class(c: Column) -> Column:
    """The name of the outer class; null if there is none."""
    pack = package_name(c)
    return F.when(outer_file_name(c).isNotNull(), F.when(pack == "", outer_file_name(c)).otherwise(F.concat_ws(".", pack, outer_file_name(c))))


def top_level_class(c: Column) -> Column:
    """The name of the top level class: cut at the first ``$`` after the last dot, unless pathological."""
    file = file_name(c)
    return F.when(~is_pathological(file) & file.contains("$"), F.regexp_extract(c, r"(?s)^((?:.*\.)?[^.$]*)\$[^.]*$", 1)).otherwise(c)


def outer_classes(c: Column) -> Column:
    """All outer classes of a class, as an array from the top level down."""
    file, pack = file_name(c), package_name(c)
    parts = F.split(file, r"\$")
    names = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.when(pack == "", F.lit("")).otherwise(F.concat(pack, F.lit("."))), F.array_join(F.slice(parts, F.lit(1), i), "$")))
    return F.when(~is_pathological(file) & file.contains("$"), names).otherwise(F.array().cast("array<string>"))


def ancestor_packages(package: Column) -> Column:
    """A package and all above it, the default package first."""
    parts = F.split(package, r"\.")
    deeper = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return F.when(package == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), deeper))


def tree_path(package: Column) -> Column:
    """A package's parts; arrays of them sort as a walk through the package tree goes, a package before what is below it."""
    return F.when(package == "", F.array().cast("array<string>")).otherwise(F.split(package, r"\."))


def split_name(c: Column) -> Column:
    """The parts of a name; raises an error at an empty part."""
    parts = F.split(c, r"\.")
    return F.when(F.exists(parts, lambda x: x == ""), F.raise_error(F.concat(F.lit("empty part in name: "), c)).cast("array<string>")).otherwise(parts)


def to_regex(name: str) -> str:
    """A pattern for a name: dots are escaped, nothing else."""
    return name.replace(".", r"\.")


def starts_with_name(c: Column, name: str) -> Column:
    """Equal to the name, or followed by a dot or ``$``; the empty name starts all."""
    return F.lit(True) if name == "" else (c == name) | c.startswith(f"{name}.") | c.startswith(f"{name}$")


def ends_with_name(c: Column, name: str) -> Column:
    """Equal to the name, or preceded by a dot or ``$``; the empty name ends all."""
    return F.lit(True) if name == "" else (c == name) | c.endswith(f".{name}") | c.endswith(f"${name}")


def contains_name(c: Column, name: str) -> Column:
    """The name with a dot, ``$`` or nothing on either side; the empty name is in all."""
    if name == "":
        return F.lit(True)
    bounded = F.concat(F.lit("."), c, F.lit("."))
    return reduce(lambda found, x: found | x, [bounded.contains(f"{a}{name}{b}") for a in ".$" for b in ".$"])
