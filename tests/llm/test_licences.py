import pytest

from weekloom.llm import licences

PLAIN = ["the river runs past the old mill", "a licence to fish was granted", "open the window and release the bird",
         "mit freundlichen Grüßen", "general public opinion version three", "all rights of way are reserved for walkers"]


@pytest.fixture(scope="module")
def model():
    return licences.fit([f"{a} {b}" for a in PLAIN for b in PLAIN] * 4)


def test_notices_are_found_and_named(documents, model):
    texts = ["Intro\nReleased under the MIT License.\nmore", "x\n\nLicensed under the Apache License, Version 2.0.",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
             "\n".join(PLAIN), None, "", "\n", "MIT", "word " * 30_000 + "\nReleased under the MIT License."]
    got = {r.doc_id: r for r in licences.licence_scan(documents(texts), model=model).collect()}
    assert [got[i].families for i in range(10)] == ["mit", "apache", "gpl", "cc-by-nc,mit", "", "", "", "", "", "mit"]
    assert [list(got[i].places) for i in (0, 1, 3, 9)] == [[1], [2], [0, 1], [1]]
    assert [got[i].n_lines for i in range(8)] == [3, 3, 1, 2, 6, 0, 0, 2]


def test_unseen_notices_are_told_from_prose(model):
    rows = licences.notices(__import__("numpy").random.default_rng(99), PLAIN, 20)
    odds = model.probabilities(licences.Paragraphs(licences._texts([t for t, _ in rows])))
    right = (odds.argmax(axis=1) == [k for _, k in rows]).mean()
    assert right > 0.95


def test_model_from_the_corpus_and_empty_tables(documents):
    docs = documents([*PLAIN, "Released under the MIT License."], ids=[0, 1, 2, 3, 4, 4, 6])
    got = licences.licence_scan(docs)
    assert [r.doc_id for r in got.collect() if r.n_notices] == [6] and got.count() == 7
    assert licences.licence_scan(docs.limit(0)).count() == 0


GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License."""


def test_wrapped_short_and_diluted_notices(documents, model):
    prose = " ".join(PLAIN * 12)
    narrow = "\n".join("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                       "Public License as published by the Free Software Foundation.".split())
    texts = [GPL, BSD, MIT, APACHE, "Intro\n\n" + GPL + "\n\n" + PLAIN[0], PLAIN[0] + "\n" + BSD + "\n" + PLAIN[1], "All rights reserved.",
             "Copyright 2020 Someone. All rights reserved.", f"{prose} Released under the MIT License. {prose}", narrow,
             "Permission is hereby granted, free of charge, to any\n\nperson obtaining a copy of this software",
             "\n".join(PLAIN * 5), "all rights\nof way are\nreserved", "Released under the MIT License.\nReleased under the MIT License."]
    got = [r for r in sorted(licences.licence_scan(documents(texts), model=model).collect(), key=lambda r: r.doc_id)]
    assert [r.families for r in got[:10]] == ["gpl", "bsd", "mit", "apache", "gpl", "bsd", "proprietary", "proprietary", "mit", "gpl"]
    assert [r.families for r in got[11:]] == ["", "", "mit"]
    assert [list(got[i].places) for i in (1, 3, 5)] == [[0, 1], [0, 1], [1, 2]] and list(got[4].places)[:2] == [2, 3]
    assert [got[i].n_notices for i in (0, 1, 2, 3, 13)] == [1, 1, 1, 1, 2]
