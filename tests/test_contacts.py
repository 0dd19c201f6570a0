"""What binding a sender refuses, and what becomes of contacts."""

import pytest

from threadlake.operators import people as H

CONTACTS = "id long, identity_token string, display_name string, custom_avatar_path string, note string, updated_at string"
BINDINGS = "contact_id long, sender_id long, account_label string, is_primary boolean"


@pytest.fixture
def book(spark):
    contacts = spark.createDataFrame([(1, "t1", "A", None, None, ""), (2, "t2", "B", None, None, ""), (3, "t3", "C", "pic", None, "")], CONTACTS)
    bindings = spark.createDataFrame([(1, 10, None, True), (1, 11, None, False), (2, 20, None, True), (3, 30, None, True)], BINDINGS)
    return contacts, bindings, spark.createDataFrame([(k,) for k in (10, 11, 20, 30, 40)], "id long")


def seen(found):
    contacts, bindings = found
    return {r.id: r.updated_at for r in contacts.collect()}, sorted((r.contact_id, r.sender_id, r.account_label, r.is_primary) for r in bindings.collect())


@pytest.mark.parametrize(
    ("contact", "sender", "more", "error"),
    [
        (9, 40, {}, KeyError), (1, 99, {}, KeyError), (2, 10, {}, ValueError), (1, 40, {"token": "old"}, ValueError), (1, 10, {"unbound": True}, ValueError), (2, 10, {"source": 3}, ValueError), (2, 10, {"source": 1, "source_token": "old"}, ValueError),
        (1, 10, {"source": 1}, ValueError), (2, 40, {"source": 1}, ValueError),
    ],
)
def test_bindings_that_are_refused(book, contact, sender, more, error):
    with pytest.raises(error):
        H.bind(*book, contact, sender, "now", **more)


def test_bindings(book):
    updated, rows = seen(H.bind(*book, 2, 40, "now", label="x", primary=True, token="t2"))
    assert updated == {1: "", 2: "now", 3: ""} and (2, 40, "x", True) in rows and (2, 20, None, False) in rows
    assert seen(H.bind(*book, 1, 11, "now", label="own"))[1][:2] == [(1, 10, None, True), (1, 11, "own", False)]
    updated, rows = seen(H.bind(*book, 2, 10, "now", force=True))
    assert updated == {1: "now", 2: "now", 3: ""} and (1, 11, None, True) in rows  # the other one becomes primary
    assert set(seen(H.bind(*book, 1, 20, "now", source=2, source_token="t2"))[0]) == {1, 3}  # the last sender goes, and its contact
    assert set(seen(H.bind(*book, 1, 30, "now", force=True))[0]) == {1, 2, 3}  # but for one with a picture


def test_names_and_deletion(book):
    contacts, bindings, _ = book
    with pytest.raises(ValueError):
        H.create_contact(contacts, 4, "t4", "  ", "now")
    with pytest.raises(ValueError):
        H.update_contact(contacts, 1, "", "now")
    assert seen(H.delete_contact(contacts, bindings, 1)) == ({2: "", 3: ""}, [(2, 20, None, True), (3, 30, None, True)])
