"""Operators on small frames: edges that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from threadlake.functions import hashing as X
from threadlake.functions import text as T
from threadlake.operators import conversations as C
from threadlake.operators import dedup, paging, people, present, search, stats, upsert


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("query", "whole"), [("abc", True), ("ab", False), ("abc de", False), ("abc def", True), ("", False), ("  ", False), ("日本語", True), ("日本", False), ("a b c", False), ("éàü", True), ("😀😀😀", True)])
def test_match_mode(query, whole):
    assert search.whole_words(query) is whole


@pytest.mark.parametrize(("text", "cursor"), [("5_7", (5, 7)), ("-5_7", (-5, 7)), (None, None), ("", None), ("5", None), ("a_b", None), ("5_", None)])
def test_cursor(text, cursor):
    assert paging.decode_cursor(text) == cursor
    if cursor:
        assert paging.encode_cursor(*cursor) == text


def test_clamps():
    assert [paging.clamp(x, 60, 200) for x in (None, 0, -3, 5, 999)] == [60, 1, 1, 5, 200]


def test_search_pages_concatenate_to_the_whole(spark):
    messages = spark.createDataFrame([(k, 1, 1, k // 3, "text", f"needle {k}", f"needle {k}", "s") for k in range(10)], "id long, conversation_id long, sender_id long, timestamp_ms long, message_type string, content string, search_text string, sender_name string")
    convs = spark.createDataFrame([(1, "qq", "group", "T")], "id long, platform string, kind string, title string")
    cursor, seen = None, []
    while True:
        page = search.search(messages, convs, "needle", cursor=cursor, limit=4).collect()
        seen += [r.id for r in page[:4]]
        cursor = paging.next_cursor(page, 4)
        if not cursor:
            break
    assert seen == list(range(9, -1, -1))
    assert search.search(messages, convs, "   ").count() == 0
    assert search.search(messages, convs, "NEEDLE 3").count() == 1 and search.search(messages, convs, "%").count() == 0


def test_full_text_folds_all_letters_and_substrings_only_ascii(spark):
    rows = spark.createDataFrame([("ÉCOLE Ab_1",)], "search_text string")
    hit = lambda q: rows.filter(search.matches(q)).count() == 1
    assert hit("école") and not hit("ecole") and hit("ab_1") and not hit("a_b_") and not hit("éc") and hit("aB")


def test_snippet(spark):
    f = lambda c, s, q: one(spark, T.snippet(F.lit(c), F.lit(s), q))[0]
    assert f("x" * 30 + "hit" + "y" * 100, "", "HIT") == "…" + "x" * 20 + "hit" + "y" * 57
    assert f("a\nhit b", "", "hit") == "a hit b"
    assert f("none", "the hit", "hit") == "the hit" and f("head only", None, "zzz") == "head only" and f(None, None, "q") == ""


def test_text_helpers(spark):
    assert one(spark, T.clean(F.lit(" \u0000\t　x y \n")))[0] == "x y" and one(spark, T.clean(F.lit(None).cast("string")))[0] == ""
    assert one(spark, T.first_non_empty(F.lit(None).cast("string"), F.lit(""), F.lit("b")))[0] == "b"
    assert one(spark, T.unique_list(F.lit("a"), F.lit(""), F.lit(None), F.lit("b"), F.lit("a")))[0] == ["a", "b"]
    assert T.like_escape("a/b%c_d") == "a//b/%c/_d" and T.like_escape(None) == ""
    assert one(spark, T.markdown_text(F.lit("> [label](x) ![](p.png)\n> y")))[0] == "label p.png\ny"
    assert one(spark, T.safe_title(F.lit('a/b:c?"')), T.safe_title(F.lit("..")))[:] == ("abc", "")
    assert [one(spark, T.format_bytes(F.lit(n)))[0] for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KiB", "3.0 MiB", "5.00 GiB"]
    assert [one(spark, T.as_long(F.lit(x)))[0] for x in ("12", "12.9", "-3.9", "x", "")] == [12, 12, -3, None, None]


@pytest.mark.parametrize(("text", "ms"), [("20240102", 1704153600000), ("1704153600", 1704153600000), ("1704153600123", 1704153600123), ("1704153600.9", 1704153600000), ("2024-01-02 03:04:05", 1704164645000), ("2024年1月2日", 1704153600000), ("2024/1/2 3:04", 1704164640000), ("2024-01-02T03:04:05Z", 1704164645000), ("soon", None), ("", None)])
def test_flexible_timestamp(spark, text, ms):
    assert one(spark, T.flexible_timestamp(F.lit(text)))[0] == ms


def test_every_date_format_and_no_crash(spark):
    day, minute, second, milli = 1709424000000, 1709431440000, 1709431445000, 1709431445678  # 2024-03-03 [02:04[:05[.678]]]
    forms = {
        "2024-03-03 03:04:05": second + 3600000, "2024-03-03 02:04:05.678": milli, "2024-03-03 02:04": minute, "2024-3-3 02:04:05": second, "2024-3-3 02:04:05.678": milli, "2024-3-3 02:04": minute,
        "2024/03/03 02:04:05": second, "2024/03/03 02:04:05.678": milli, "2024/03/03 02:04": minute, "2024/3/3 02:04:05": second, "2024/3/3 02:04": minute,
        "2024.03.03 02:04:05": second, "2024.03.03 02:04:05.678": milli, "2024.03.03 02:04": minute, "2024.3.3 02:04:05": second, "2024.3.3 02:04": minute,
        "2024-03-03T10:04:05+08:00": second, "2024-03-03T10:04:05.678+08:00": milli, "2024-03-03T02:04:05Z": second, "2024-03-03T02:04:05.678Z": milli, "2024-03-03T02:04:05": second, "2024-03-03T02:04:05.678": milli,
        "2024-03-03": day, "2024-3-3": day, "2024/03/03": day, "2024/3/3": day, "2024.03.03": day, "2024.3.3": day, "2024年3月3日 02:04": minute, "2024年03月03日": day,
        "NaN": None, "Infinity": None, "-Infinity": None, "1e300": None, "-9223372036854775808": None, "9223372036854775807": 9223372036854775807, "99999999999999999999": None, "1.5e9": 1500000000000,
        "-5": -5000, "-20000000000": -20000000000000, "20241399": 20241399000, "2024-13-03": None, "2024/3-3": None, "2024-03-03 25:00": None, " 5 ": 5000, "+5": 5000, "1e": None, ".": None,
    }
    rows = spark.createDataFrame(list(forms.items()), "t string, want long")
    assert {r.t: r.got for r in rows.select("t", T.flexible_timestamp(F.col("t")).alias("got")).collect()} == forms
    least = -(2**63)
    assert one(spark, T.seconds_or_millis(F.lit(least)), T.seconds_or_millis(F.lit(-20000000000)))[:] == (None, -20000000000000)


def test_canonical_json_and_ids(spark):
    got = one(spark, X.canonical_json({"b": F.lit(None).cast("string"), "a": F.lit('é"\n')}))[0]
    assert got == '{"a":"é\\"\\n","b":null}'
    a, b, c = one(spark, X.synthetic_sender(F.lit("c"), F.lit(" n ")), X.synthetic_sender(F.lit("c"), F.lit("n")), X.synthetic_sender(F.lit("c"), F.lit("  ")))
    assert a == b != c and a.startswith("synthetic:")


FOLD = "conversation_id string, native_id string, local_id string, semantic_hash string, payload_hash string, compatible array<string>, seq long"


def states(spark, rows, platform):
    got = dedup.fold_state(spark.createDataFrame(rows, FOLD), platform).collect()
    return {r.seq: (r.state, r.target) for r in got}


def test_fold_states(spark):
    rows = [
        ("c", "n", None, "s1", "p1", [], 1), ("c", "n", None, "s1", "p1", [], 2), ("c", "n", None, "s2", "p2", ["p1"], 3), ("c", "n", None, "s9", "p3", [], 4),
        ("c", None, "L", "m", "q1", None, 5), ("c", None, "L", "m", "q2", None, 6), ("d", "n", None, "s1", "p1", [], 7),
    ]
    assert states(spark, rows, "qq") == {1: ("new", None), 2: ("duplicate", 1), 3: ("duplicate", 1), 4: ("revision", 1), 5: ("new", None), 6: ("revision", 5), 7: ("new", None)}
    assert states(spark, rows, "wechat")[4] == ("variant", None)


def test_reimport_changes_nothing(spark):
    rows = spark.createDataFrame([(k, "c", f"n{k % 3}", f"p{k % 4}") for k in range(12)], "seq long, conversation_id string, native_id string, payload_hash string")
    kept = rows.join(dedup.dedup_state(rows).filter("state <> 'duplicate'"), "seq")
    again = kept.select("seq", "conversation_id", "native_id", "payload_hash").unionByName(rows.withColumn("seq", F.col("seq") + 100))
    assert dedup.dedup_state(again).filter("seq >= 100 and state <> 'duplicate'").count() == 0


def test_fold_rules_by_accounts(spark):
    rows = [(1, "a", "x-default"), (2, "a", "real"), (3, "b", "r1"), (4, "b", "r2"), (5, "b", "x-default"), (6, "c", "x-default"), (7, "c", "y-DEFAULT"), (8, "d", "real"), (9, "e", "r1"), (10, "e", "r2"), (11, "e", "x-default"), (12, "e", "y-default")]
    got = upsert.fold_map(spark.createDataFrame(rows, "id long, native string, account_id string"), ["native"])
    assert {r.id: r.canonical_id for r in got.collect()} == {1: 2, 2: 2, 6: 6, 7: 6, 11: 11, 12: 11}


def test_binding_transitions(spark):
    schema = "contact_id long, sender_id long, account_label string, is_primary boolean"
    bound = spark.createDataFrame([(1, 10, "a", True), (1, 11, "b", False), (2, 20, "c", True)], schema)
    move = spark.createDataFrame([(10, 2, "z", False)], "sender_id long, contact_id long, account_label string, is_primary boolean")
    after = {r.sender_id: (r.contact_id, r.is_primary) for r in people.rebind(bound, move, force=True).collect()}
    assert after == {10: (2, False), 11: (1, True), 20: (2, True)}
    with pytest.raises(Exception, match="another contact"):
        people.rebind(bound, move).collect()
    assert {r.sender_id: r.is_primary for r in people.unbind(bound, move).collect()} == {11: True, 20: True}


def test_presentation(spark):
    paths = F.array(F.lit("a\\B.png"), F.lit(None).cast("string"))
    shown = lambda c, media: one(spark, present.display_content(F.lit(c), paths, F.lit(media)))[0]
    assert shown(" A/b.PNG ", True) == "" and shown("[图片] 1", True) == "" and shown("[图片] 1", False) == "[图片] 1" and shown("words", True) == "words"
    assert [one(spark, present.display_kind(F.lit(k)))[0] for k in ("Voice", " ", "IMAGE")] == ["audio", "unknown", "image"]
    times = spark.createDataFrame([(1, k, t, "incoming", "x") for k, t in enumerate((-5, 0, 86400000, 10**18))], "conversation_id long, id long, timestamp_ms long, direction string, content string")
    assert sorted((r.id, r.date) for r in present.date_separators(times).collect()) == [(0, "1970-01-01"), (2, "1970-01-02"), (3, "9999-12-31")]
    assert present.with_separators(times).filter("entry = 'separator'").count() == 3


def test_empty_tables(spark):
    messages = spark.createDataFrame([], "id long, conversation_id long, sender_id long, timestamp_ms long, platform string, direction string, message_type string, content string, search_text string, sender_name string")
    convs = spark.createDataFrame([(1, "qq", "group", "T")], "id long, platform string, kind string, title string")
    assert C.conversation_list(convs, messages).first().preview is None
    assert C.context(messages, 1).count() == C.timeline_page(messages, 1).count() == people.self_sender(messages).count() == 0
    files = spark.createDataFrame([], "message_id long, is_available boolean")
    media = spark.createDataFrame([], "id long, size long")
    assert stats.archive_stats(messages, convs, convs, files, media).first().media_bytes == 0


def test_labels(spark):
    from threadlake.functions import labels as N

    assert [N.parse_filter_tag(t) for t in ("QQ | Group", "qq", "a|b|c", "|x", None)] == [("qq", "group"), (None, None), (None, None), (None, None), (None, None)]
    row = one(spark, N.initials(F.lit("  ")), N.sender_line(F.lit(" Ann "), F.lit(" work ")), N.sender_line(F.lit(""), F.lit("x")), N.platform_label(F.lit("SQL")), N.platform_label(F.lit("irc")))
    assert row[:] == ("?", "Ann · work", "", "SQL", "irc")


def test_duplicates_refresh_hashes_and_rows_without_ids_meet(spark):
    row = lambda seq, payload, semantic="s", native="n", compatible=None, platform="wechat", local=None: ("c", native, local, semantic, payload, compatible, seq, platform)
    schema = "conversation_id string, native_id string, local_id string, semantic_hash string, payload_hash string, compatible array<string>, seq long, platform string"
    fold = lambda rows: [(r.state, r.target) for r in sorted(dedup.fold_state(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.seq)]
    # the stored row takes over the newer payload, so the oldest one is no longer a duplicate
    assert fold([row(1, "p1"), row(2, "p2", compatible=["p1"]), row(3, "p3", compatible=["p2"]), row(4, "p1")]) == [("new", None), ("duplicate", 1), ("duplicate", 1), ("revision", 1)]
    assert fold([row(1, "p1", "a"), row(2, "p2", "b"), row(3, "p3", "a", platform="qq")]) == [("new", None), ("variant", None), ("revision", 1)]
    assert fold([row(1, "p1", "a", local="7"), row(2, "p2", "b", local="7"), row(3, "p3", "c", local="")]) == [("new", None), ("revision", 1), ("variant", None)]
    # without a native id: by meaning, by payload, by a compatible payload, and never with another conversation's or an id's rows
    free = [row(1, "p1", "a", None), row(2, "p1", "b", None), row(3, "p9", "b", None, ["p5"]), row(4, "p5", "z", None), row(5, "p6", "y", None), row(6, "p1", "a")]
    assert fold(free) == [("new", None), ("duplicate", 1), ("revision", 1), ("new", None), ("new", None), ("new", None)]
    assert fold([row(1, "p5", "a", None), row(2, "p6", "b", None, ["p5"]), row(3, "p7", "c", None, ["p6"])]) == [("new", None), ("duplicate", 1), ("duplicate", 1)]


def test_rows_without_a_native_id_keep_their_state(spark):
    rows = spark.createDataFrame([("c", None, "p", 1), ("c", None, "p", 2), ("c", None, "q", 3), ("c", "n", "p", 4)], "conversation_id string, native_id string, payload_hash string, seq long")
    assert sorted((r.seq, r.state) for r in dedup.dedup_state(rows).collect()) == [(1, "new"), (2, "duplicate"), (3, "new"), (4, "new")]


def test_technical_content_by_its_own_list(spark):
    shown = lambda c: one(spark, present.display_content(F.lit(c), F.array().cast("array<string>"), F.lit(True)))[0]
    assert [shown(c) for c in ("[图片: a.png]", "[Image] x", "[EMOJI:1]", "[转账] 5", "[位置] here", "[通话]")] == ["", "", "", "[转账] 5", "[位置] here", "[通话]"]
