"""Project identity of a working directory, without its absolute path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folder names that mark a synchronised root, per provider, and
# the labels shown for a root itself.
ROOT_LABELS = {
    "dropbox": "Dropbox",
    "onedrive": "OneDrive",
    "google-drive": "Google Drive",
    "icloud-drive": "iCloud Drive",
    "box": "Box",
}
# A Windows drive letter, or the host and share of a network path.
DRIVE = r"^([A-Za-z]:|[\\/]{2}[^\\/]+[\\/][^\\/]+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is computed and written once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _provider(parts: Column, index: Column) -> Column:
    """Provider whose root folder is part ``index`` of a path, else null.

    Part 0 is the path's root, as ``/`` or ``D:\\``.
    """
    before = F.when(index > 0, F.lower(F.get(parts, index - 1)))

    def of(name: Column) -> Column:
        box_place = (
            (index == 1)
            | ((index == 3) & F.lower(F.get(parts, F.lit(1))).isin("users", "home"))
            | F.coalesce(before == "cloudstorage", F.lit(False))
        )
        return (
            F.when(name.rlike(r"^dropbox($| \(.*\)$|-)"), F.lit("dropbox"))
            .when(name.rlike(r"^onedrive($| personal$|-| - )"), F.lit("onedrive"))
            .when(name.rlike(r"^(googledrive|google drive)$|^googledrive-"), F.lit("google-drive"))
            .when(
                name.isin("icloud drive", "iclouddrive")
                | ((name == "com~apple~clouddocs") & F.coalesce(before == "mobile documents", F.lit(False))),
                F.lit("icloud-drive"),
            )
            .when((name == "box-box") | ((name == "box") & box_place), F.lit("box"))
        )

    return let(F.lower(F.get(parts, index)), of)


def project_identity(path: Column) -> Column:
    """Struct of ``key`` and ``name`` for an absolute directory, else null.

    Copies of one synchronised folder on several machines get one key: it is
    made of the provider and the path below its root. Other folders keep their
    full path, without regard to case on Windows.
    """
    drive = F.regexp_extract(path, DRIVE, 1)
    windows = drive != ""
    rest = F.regexp_replace(F.substring(path, F.length(drive) + 1, F.length(path)), r"\\", "/")
    share = (F.length(drive) > 2) & (rest == "")
    body = F.when(share, F.lit("/")).when(windows, rest).otherwise(path)
    root = F.when(windows, F.concat(drive, F.lit("\\"))).otherwise(F.lit("/"))
    folders = F.filter(F.split(body, "/"), lambda part: (part != "") & (part != "."))

    def located(parts: Column) -> Column:
        return let(_place(parts, windows), lambda place: _identity(parts, place, windows))

    known = let(F.concat(F.array(root), folders), located)
    return F.when(body.startswith("/") & (F.trim(path) != ""), known)


def _place(parts: Column, windows: Column) -> Column:
    """Provider and the folders below its root, null without one."""
    hits = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: _provider(parts, i).isNotNull())
    # A Windows drive letter can itself stand for the synchronised root.
    drive = F.struct(F.lit("google-drive").alias("provider"), F.slice(parts, 3, F.size(parts)).alias("below"))

    def found(hit: Column) -> Column:
        below = F.slice(parts, hit + 2, F.size(parts))
        return let(
            _provider(parts, hit),
            lambda provider: F.struct(
                provider.alias("provider"),
                F.when(
                    (provider == "google-drive") & (F.lower(F.get(below, F.lit(0))) == "my drive"),
                    F.slice(parts, hit + 3, F.size(parts)),
                ).otherwise(below).alias("below"),
            ),
        )

    own_drive = windows & F.coalesce(F.lower(F.get(parts, F.lit(1))) == "my drive", F.lit(False))
    place = let(
        F.get(hits, F.lit(0)), lambda hit: F.when(hit.isNotNull(), found(hit)).when(own_drive, drive)
    )
    return F.when(~F.array_contains(parts, ".."), place)


def _identity(parts: Column, place: Column, windows: Column) -> Column:
    folders = F.slice(parts, 2, F.size(parts))
    provider, below = place["provider"], place["below"]
    root = F.when(windows, F.regexp_replace(F.get(parts, F.lit(0)), r"\\", "/")).otherwise(F.lit("/"))
    plain = F.concat(root, F.array_join(folders, "/"))
    plain = F.when(windows, F.lower(plain)).otherwise(plain)
    shared = F.concat(F.lit('["'), provider, F.lit('",'), F.to_json(below), F.lit("]"))
    root_label = F.element_at(F.create_map(*[F.lit(x) for pair in ROOT_LABELS.items() for x in pair]), provider)
    last = F.when(F.size(folders) > 0, F.try_element_at(folders, F.lit(-1))).otherwise(F.lit("Filesystem root"))
    name = F.when(provider.isNotNull() & (F.size(below) == 0), root_label).otherwise(last)
    return F.struct(F.sha2(F.coalesce(shared, plain), 256).alias("key"), name.alias("name"))


def with_project(df: DataFrame, cwd: str, key: str = "project_key", name: str = "project_name") -> DataFrame:
    """Add key and label of a directory column; both null for anything but an absolute path."""
    found = df.withColumn("_project", project_identity(F.col(cwd)))
    return found.withColumns({key: F.col("_project.key"), name: F.col("_project.name")}).drop("_project")
