import pytest

from minekit.llm import licenses

ROWS = [
    (1, "A story.\nReleased under the MIT License.\nThe end."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, "You need a driving license to rent a car, said the general public."),
    (6, None),
    (7, ""),
    (8, "word " * 20_000 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that " + "word " * 500),
    (None, "Released under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (9, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\r\nLicensed under CC BY-NC 4.0."),
    (10, "!!! ???\n\n\n"),
    (11, "This work is licensed under the Martian Common License, version 9, of the colony."),
]
WANT = [
    (1, "MIT"), (2, "Apache"), (3, "GPL"), (4, "CC-BY-NC"), (5, "none"), (6, "none"), (7, "none"), (8, "BSD"), (None, "MIT"), (2, "Apache"), (10, "none"),
]


@pytest.fixture(scope="module")
def scanned(spark, frame):
    return licenses.licence_scan(frame(ROWS)).collect()


def test_families(scanned):
    got = [(r.doc_id, r.license) for r in scanned]
    assert len(got) == len(ROWS)
    assert sorted((x for x in got if x[0] not in (9, 11)), key=repr) == sorted(WANT, key=repr)


def test_several_licences_and_probabilities(scanned):
    both = next(r for r in scanned if r.doc_id == 9)
    assert both.licenses == ["CC-BY-NC", "MPL"] and both.n_segments == 2
    assert all(0 <= r.probability <= 1 and (r.probability > 0) == (r.license != "none") for r in scanned)


def test_a_licence_of_no_known_family_is_unknown(scanned):
    assert next(r.license for r in scanned if r.doc_id == 11) == "unknown"


def test_copies_keep_the_probability_of_a_single_row(frame):
    texts = ["licensed under the Apache terms", "GNU General Public License applies", "Released under the MIT License.\nAll of it."]
    single = [(i, t) for i, t in enumerate(texts)]
    copies = single + [(i + 10, t) for i, t in enumerate(texts) for _ in range(3)] + [(None, texts[2])] * 2
    got = licenses.licence_scan(frame(copies)).collect()
    assert len(got) == len(copies)
    for i, text in single:
        rows = [r for r in got if r.doc_id in (i, i + 10) or (r.doc_id is None and i == 2)]
        assert len({(r.license, round(r.probability, 12), tuple(r.licenses), r.n_segments) for r in rows}) == 1


def test_empty_table(frame):
    assert licenses.licence_scan(frame([])).count() == 0


def test_main_path_runs_no_python(documents, capsys):
    licenses.licence_scan(documents).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_license_lines_of_the_documents(documents):
    """Every document with a known notice line, and no other, gets that family."""
    lines = {"mit license": "MIT", "apache license": "Apache", "gnu general public": "GPL", "cc by-nc": "CC-BY-NC"}
    got = {r.doc_id: r.license for r in licenses.licence_scan(documents).collect()}
    for r in documents.collect():
        assert got[r.doc_id] == next((f for x, f in lines.items() if x in r.text.lower()), "none")


def test_every_paragraph_of_a_licence_gets_its_family(frame):
    """Body paragraphs, the warranties among them, as they stand in a file: wrapped in other text and in capitals as given."""
    paragraphs = [(family, text) for family, texts in licenses.TEMPLATES.items() for text in texts]
    rows = [(i, f"Some words of a page.\n{text}\nMore words of a page.") for i, (_, text) in enumerate(paragraphs)]
    got = {r.doc_id: r.license for r in licenses.licence_scan(frame(rows)).collect()}
    wrong = [(family, got[i], text) for i, (family, text) in enumerate(paragraphs) if got[i] != family]
    assert not wrong, wrong
