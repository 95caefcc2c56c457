"""Speaker turns: the cleaning rules by example, the turns against a plain loop."""

from __future__ import annotations

import random

import pytest

from quillon.llm import transcripts as X

VOICES = [("solene-quervaudec", "Solène Quervaudec", "Mme"), ("elie-bondurieux", "Élie Bondurieux", "M.")]


@pytest.mark.parametrize(
    ("line", "voice", "words"),
    [
        ("Solène Quervaudec : Bonjour", 0, "Bonjour"),
        ("Solene Quervaudec: bonjour", 0, "bonjour"),
        ("SOLENE QUERVAUDEC :  oui", 0, "oui"),
        ("MME QUERVAUDEC : non", 0, "non"),
        ("Mme Quervaudec. – hum", 0, ""),
        ("S. Quervaudec –  Loin", 0, "Loin"),
        ("Quervaudec (PDL) : Dans la foulée", 0, "Dans la foulée"),
        ("** Bondurieux ** : oui", 1, "oui"),
        (">> Élie Bondurieux : euh...", 1, ""),
        ("- Élie Bondurieux : {jingle}", 1, ""),
        ("[Élie Bondurieux]  des assistants", 1, "des assistants"),
        ("<v Élie Bondurieux>mot</v>", 1, "mot"),
        ("0'16'' [Élie Bondurieux] raccordés à heu", 1, "raccordés à"),
        ("<00:01:15.480> M. Élie Bondurieux : autant", 1, "autant"),
        ("Élie Bondurieux: [0h02m16s] C'est au euh..., nord", 1, "C'est au nord"),
        ("00:02:18,200 --> la députée <c>de</c> Eslorac", None, "la députée de Eslorac"),
        ("00:00:03,200 --> >> Élie Bondurieux : Pour une élue", 1, "Pour une élue"),
        ("00:00:03,200 --> 00:00:05,200 - Élie Bondurieux : Pour", 1, "Pour"),
        ("Mme Quervaudec. –  00:00:03,200 --> Je propose", 0, "Je propose"),
        ("[00:00:03] (00:00:03) 00:00:03 <00:00:03> mot", None, "mot"),
        ("Solène Quervaudec a raison : dessous", None, "Solène Quervaudec a raison : dessous"),
        ("le dit Élie Bondurieux : hier", None, "le dit Élie Bondurieux : hier"),
        ("euuh, hum mmh", None, ""),
        ("(Applaudissements sur plusieurs bancs.)", None, ""),
        ("♪ ♪ *brouhaha* <bruit de micro> [silence 4 s]", None, ""),
        ("un (bis) deux (rires) trois", None, "un (bis) deux trois"),
        ("rhum et heureux", None, "rhum et heureux"),
        ("200", None, "200"),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_clean(line, voice, words):
    got = X.Cleaner(VOICES).clean(line)
    assert got == (None if voice is None else VOICES[voice][0], words)


def loop(rows):
    """Turn starts by one pass over sorted pieces (video, at, no, label, words)."""
    out, voice, before, last = [], None, None, None
    for video, at, no, label, words in sorted(rows, key=lambda r: (r[0], -1e300 if r[1] is None else r[1], r[2])):
        if video != last:
            voice, before, last = None, (), video
        voice = label or voice
        if words:
            if before == () or before != (voice,):
                out.append((video, no, voice))
            before = (voice,)
    return sorted(out, key=repr)


def pieces(seed, n=400, videos=3):
    rnd = random.Random(seed)
    rows = {}
    for no in range(n):
        video = 0 if no % 3 == 0 else rnd.randrange(videos)
        rows[video, no] = (video, rnd.choice([None, rnd.randrange(0, 9000) + 0.5, float(rnd.randrange(0, 9000))]), no, rnd.choice([None, None, None, "a", "b"]), rnd.choice(["", "mot", "deux mots"]))
    return list(rows.values())


@pytest.mark.parametrize("stretch", [1.0, 600.0, 1e9])
def test_turns_match_a_loop_whatever_the_stretch(spark, stretch):
    rows = pieces(int(stretch) % 97)
    df = spark.createDataFrame(rows, "video_id long, at double, no int, label string, words string")
    assert sorted((tuple(r) for r in X.turn_starts(df, stretch).collect()), key=repr) == loop(rows)
    parts = X.clean_turns(df, stretch).collect()
    assert sorted(((r["video_id"], r["start_no"], r["speaker"]) for r in parts if r["part"] == 1), key=repr) == loop(rows)
    assert sum(len(r["text"].split()) for r in parts) == sum(len(r[4].split()) for r in rows)


def test_tables(spark):
    cues = spark.createDataFrame(
        [(1, "s", 2, 9, "fin"), (1, "s", 1, 5, "Quervaudec : bonjour"), (1, "s", 1, 5, "Quervaudec : bonjour"), (1, "s", 3, 7, "BONDURIEUX :"), (1, "s", 4, 4, None), (2, "s", 1, None, "sans voix"), (None, "s", 1, 1, "x"), (1, "s", None, 1, "x")],
        "video_id long, source_id string, seq int, t int, line string")
    voices = spark.createDataFrame(VOICES, "voice_id string, full_name string, honorific string")
    got = sorted((tuple(r) for r in X.turn_starts(X.cue_pieces(cues, voices)).collect()), key=repr)
    assert got == [(1, 1, "solene-quervaudec"), (1, 2, "elie-bondurieux"), (2, 1, None)]
    turns = spark.createDataFrame(
        [(1, 1, 0.0, 1.0, "SPEAKER_00", "un"), (1, 2, 1.0, 2.0, None, "deux"), (1, 3, 2.0, 3.0, "?", "hum"), (1, 4, 3.0, 4.0, "voix n° 07", "trois"), (1, 4, 3.0, 4.0, "voix n° 07", "trois"), (2, 1, 0.0, 1.0, "", "x"), (None, 1, 0.0, 1.0, "", "x"), (2, None, 0.0, 1.0, "", "x")],
        "video_id long, turn_no int, start_s double, end_s double, speaker string, text string")
    got = sorted((tuple(r) for r in X.turn_starts(X.turn_pieces(turns)).collect()), key=repr)
    assert got == [(1, 1, "0"), (1, 4, "7"), (2, 1, None)]
    assert X.turn_starts(X.turn_pieces(turns.limit(0))).count() == 0
    assert X.turn_starts(X.cue_pieces(cues.limit(0), voices)).count() == 0
    assert X.clean_turns(X.turn_pieces(turns)).where("video_id = 1").orderBy("turn").first()["text"] == "un deux"


def test_notes_are_whole_parentheses():
    c = X.Cleaner([("v1", "Ada Brun", "Mme")])
    assert c.clean("Oui (c'est un cri du cœur) je crois")[1] == "Oui (c'est un cri du cœur) je crois"
    assert c.clean("Le fond sonore (discussion critique) est fort")[1] == "Le fond sonore (discussion critique) est fort"
    for note in ("rires", "Applaudissements sur plusieurs bancs.", "toux", "musique de fond", "vifs applaudissements à gauche", "cris", "rires dans la salle", "laughter"):
        assert c.clean(f"Oui ({note}) je crois")[1] == "Oui je crois", note
    role = "rapporteure de la commission des affaires économiques et du plan numérique"
    assert c.clean(f"Mme Brun, {role} : bonjour") == ("v1", "bonjour") and c.clean(f"Ada Brun ({role}) : bonjour") == ("v1", "bonjour")
