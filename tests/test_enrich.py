import pytest
from pyspark.errors import PySparkException

from tests import rows as R
from usagelens.functions import usage as U
from usagelens.functions.projects import with_project
from usagelens.operators import enrich


def identities(spark, *paths):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, cwd string")
    return [(r.project_key, r.project_name) for r in with_project(df, "cwd").orderBy("i").collect()]


def test_a_folder_is_named_by_its_last_part(spark):
    rows = {
        r"E:\src\Payroll": "Payroll", "/opt/build/billing-api": "billing-api", "/opt/build/billing-api/": "billing-api",
        r"\\fileserver\team": "Filesystem root", "/": "Filesystem root",
    }
    got = identities(spark, *rows)
    assert [name for _, name in got] == list(rows.values())
    assert got[1] == got[2] and got[1][0] != got[0][0]


def test_what_is_no_absolute_folder_has_no_identity(spark):
    assert identities(spark, "src/app", "", "   ", None, "app") == [(None, None)] * 5


def test_drive_letters_and_slashes_do_not_matter(spark):
    first, second, other = identities(spark, r"Q:\Data\Ledger", "q:/data/ledger/", "/data/Ledger")
    assert first[0] == second[0] != other[0]


# For every shared-folder rule: one folder as three machines may see it.
SYNCED = {
    "dropbox": ("/Users/kim/Dropbox/{}", r"F:\Dropbox\{}", r"C:\Users\lee\Dropbox (Work)\{}"),
    "onedrive": ("/Users/kim/Library/CloudStorage/OneDrive-Shared/{}", r"C:\Users\lee\OneDrive\{}", r"C:\Users\lee\OneDrive - Acme Ltd\{}"),
    "google": ("/Users/kim/Library/CloudStorage/GoogleDrive-kim@corp.invalid/My Drive/{}", "/home/lee/Google Drive/{}", r"K:\My Drive\{}"),
    "icloud": ("/Users/kim/Library/Mobile Documents/com~apple~CloudDocs/{}", r"C:\Users\lee\iCloudDrive\{}"),
    "box": ("/Users/kim/Library/CloudStorage/Box-Box/{}", r"C:\Users\lee\Box\{}"),
}


def at(place, folder):
    return place.format(folder.replace("/", "\\") if "\\" in place else folder)


@pytest.mark.parametrize("service", SYNCED)
def test_a_synced_folder_is_one_project_on_all_machines(spark, service):
    got = identities(spark, *(at(place, "plans/Q3") for place in SYNCED[service]), *(at(place, "plans/Q4") for place in SYNCED[service]))
    half = len(got) // 2
    assert len(set(got[:half])) == 1 and len(set(got[half:])) == 1 and got[0][0] != got[-1][0]
    assert (got[0][1], got[-1][1]) == ("Q3", "Q4")


def test_services_do_not_share_projects(spark):
    got = identities(spark, *(at(places[0], "plans/Q3") for places in SYNCED.values()))
    assert len({key for key, _ in got}) == len(SYNCED)


def test_folders_that_only_look_synced_stay_apart(spark):
    got = identities(spark, "/Users/kim/MyDropbox/plans/Q3", "/Users/lee/MyDropbox/plans/Q3", "/mnt/a/box/Q3", "/mnt/b/box/Q3",
                     "/Users/kim/Dropbox/../plans/Q3", "/Users/lee/Dropbox/../plans/Q3", "/Users/kim/Dropbox/plans/q3", "/Users/kim/Dropbox/plans/Q3")
    assert len({key for key, _ in got}) == len(got)


def test_thread_titles(spark):
    index = spark.createDataFrame([("a", "Index A", 0), ("a", "Later A", 1), ("b", "Index B", 0)], "id string, thread_name string, ordinal long")
    threads = spark.createDataFrame(
        [("a", " ", None, "/x", 1), ("b", "Old B", None, "/x", 1), ("b", "Name B", None, "/x", 2), ("c", "prompt", "b", "/x", 1),
         ("d", None, "gone", "/x", 1), ("e", None, None, "/x", 1)], "id string, name string, parent_id string, cwd string, version long")
    got = {r.session_id: r.title for r in enrich.thread_titles(index, threads).collect()}
    assert got == {"a": "Later A", "b": "Name B", "c": "Subagent of: Name B", "d": "Subagent of: Parent title unavailable"}


def test_message_links(spark):
    messages = spark.createDataFrame(
        [("one", "s1"), ("one", "s1"), ("same", "s1"), ("same", "s2"), ("mixed", "s1"), ("mixed", "s3")], "message_id string, session_id string")
    titles = spark.createDataFrame([("s1", "T"), ("s2", "T")], "session_id string, title string")
    dirs = spark.createDataFrame([("s1", "/w/P"), ("s2", "/w/P"), ("s3", "/w/P"), ("s3", "/w/Q")], "session_id string, cwd string")
    projects = enrich.session_projects(dirs)
    evidence = enrich.message_evidence(messages, titles, projects)
    rows = R.requests(spark, *[{"request_id": f"session:{m}", "app_type": "claude", "session_id": "old"} for m in ("one", "same", "mixed")],
                      {"request_id": "plain", "app_type": "claude", "session_id": "s1"}, {"request_id": "session:one", "app_type": "codex"})
    linked = enrich.link_messages(rows.drop("session_title", "project_key", "project_name"), evidence)
    done = enrich.attach_sessions(linked, enrich.by_session(titles, projects, "claude"))
    got = {(r.app_type, r.request_id): (r.session_id, r.link, r.session_title, r.project_name) for r in done.collect()}
    assert got[("claude", "session:one")] == ("s1", "linked", "T", "P")
    assert got[("claude", "session:same")] == ("old", "same_title", "T", "P")
    assert got[("claude", "session:mixed")] == ("old", "ambiguous", None, None)
    assert got[("claude", "plain")] == ("s1", None, "T", "P")
    assert got[("codex", "session:one")] == (None, None, None, None)
    audit = enrich.enrichment_audit(done.drop("session_provider").selectExpr("*", "CAST(NULL AS STRING) AS session_provider")).first()
    assert (audit.requests_linked_by_message_id, audit.ambiguous_message_id_requests) == (1, 1)


def test_headers(spark):
    headers = spark.createDataFrame([("s", "acme", "/w/P"), ("s", "acme", "/w/P"), ("t", None, "/w/Q")], "session_id string, model_provider string, cwd string")
    rows = R.requests(spark, {"request_id": "a", "session_id": "s"}, {"request_id": "b", "session_id": "s", "data_source": "proxy"},
                      {"request_id": "c", "session_id": "t", "project_key": "other", "project_name": "Other"}, {"request_id": "d"})
    got = {r.request_id: (r.session_provider, r.project_name) for r in enrich.attach_headers(rows.drop("session_provider"), headers).collect()}
    assert got == {"a": ("acme", "P"), "b": (None, "P"), "c": (None, None), "d": (None, None)}
    keyed = enrich.hash_sessions(rows)
    assert "session_id" not in keyed.columns


def test_conflicting_headers_fail(spark):
    headers = spark.createDataFrame([("s", "acme", None), ("s", "zeta", None)], "session_id string, model_provider string, cwd string")
    with pytest.raises(PySparkException, match="name different providers"):
        enrich.session_providers(headers).collect()


def test_session_keys(spark):
    df = spark.createDataFrame([("abc",), (" NONE ",), ("",), (None,)], "s string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(U.session_key(F.col("s"))).collect()]
    assert got[0] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and got[1:] == [None] * 3
