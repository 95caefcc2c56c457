"""Residues of templates and error pages; the article of a page."""

from __future__ import annotations

import pytest

from quillon.llm import notices as N
from quillon.llm import page_body as B
from quillon.llm import residue as R

DOCS = "doc_id long, kind string, text string, title string, template string, weight int"


def doc(no, text, title="Un titre", kind="site"):
    return (no, kind, text, title, "clash", 1)


def found(spark, *docs):
    return sorted(r[0] for r in R.residues(spark.createDataFrame(list(docs), DOCS)).collect())


@pytest.mark.parametrize("text", [
    "Bonjour {{ prenom }}, merci.", "Rédigé par ${auteur.nom} pour Le Site.", "Du texte. [À COMPLÉTER]", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "La page /x-12 est introuvable ou a été déplacée.",
    "Accès refusé. Votre adresse a été bloquée.", "Un article.\n503 – Service momentanément indisponible (incident 12).", "JavaScript is disabled. Please enable it.", "Cap Nouveau a besoin de JavaScript pour fonctionner. Code 1.",
    "Le Site est en maintenance. Merci de revenir plus tard.", "Votre session a expiré, veuillez vous reconnecter.", "noscript : contenu non disponible sans script", "Texte provisoire à remplacer avant mise en ligne (x).",
    "Un mot de fin. Impossible d'établir la connexion à la base de données (1).", "Ce contenu n'existe plus.", "a [object Object] b",
])
def test_residues(spark, text):
    assert found(spark, doc(1, "Un article. " * 30 + "\n" + text), doc(2, "Un autre article.")) == [1]


@pytest.mark.parametrize("text", [
    "La mention « accès refusé » s'affichait pour 3 500 comptes à Trenolin, reconnaît Saugaia.", "À Arnoec, des usagers sont tombés sur une « erreur 404 » en cherchant le formulaire.", "Silvanel rappelle que la page de Arnoec exige JavaScript, ce qui exclut des foyers.",
    "L'autorité a compté 8 300 cookies déposés sans accord par Esbeys.", "Le serveur de la salle a souri. La maintenance des trains reste un sujet.", "Un tableau [1] cite [2] et [12].", "", "Il a écrit a < b et {x}.",
])
def test_articles_about_such_things(spark, text):
    assert found(spark, doc(1, text)) == []


def test_alignment_tells_slots_from_wording(spark):
    slot = [doc(i, f"Montant retenu : {v} à Port{i}.") for i, v in enumerate(["{seuil}", "{montant}", "{seuil}"])]
    wording = [doc(10 + i, f"Le rapport de Val{i} cite la variable {{seuil}} sans la définir, note un élu.") for i in range(4)]
    assert found(spark, *slot, *wording) == [0, 1, 2]


def test_titles_nulls_and_repeats(spark):
    docs = [doc(None, "{{ x }}"), doc(1, None, None), doc(2, "", ""), doc(3, "Texte.", "404 Not Found"), doc(3, "Texte.", "404 Not Found"), doc(4, "Texte.", "Page introuvable"), doc(5, "Texte.", "Erreur d'appréciation au conseil"), doc(6, "Texte.", "${headline}"), doc(7, "mot " * 200_000 + "\n{{ fin }}")]
    assert found(spark, *docs) == [3, 4, 6, 7]
    assert R.residues(spark.createDataFrame([], DOCS)).count() == 0


ARTICLE = ["La présidente du conseil défend une expérimentation pour la sécurité des hôpitaux, après l'échec constaté à Verrais.", "Rogael, Silreand et un label au printemps", "– 12 400 ateliers sur le campus avant l'été", "Un proche du dossier annonce un barème pour les modèles ouverts, sans préciser qui paiera la facture au printemps."]
AROUND = ["Accueil | Idées | Sciences | Le Site", "Tout accepter", "Partager cet article de Le Site : courriel, message, impression", "À lire aussi : Rogael face à Silreand : un label sur les modèles ouverts", "Mots-clés : école, énergie", "Temps de lecture : 4 min", "Par la rédaction de Le Site", "© 2026 Le Site. Reproduction interdite sans accord écrit.", "Mentions légales / Plan du site / Accessibilité : partielle"]


WHO = ["La présidente du conseil", "Un proche du dossier", "Le collectif des lycéens", "Une chercheuse", "Le maire sortant", "La rapporteure", "Un syndicat", "Notre voisine"]
DOES = ["défend", "annonce", "repousse", "chiffre enfin", "conteste", "détaille", "soutient", "réclame"]
WHAT = ["une expérimentation", "un barème", "une taxe", "le label", "cette charte", "un pacte", "des bourses", "l'audit"]
WHERE = ["pour la sécurité des hôpitaux", "sur les modèles ouverts", "dans les lycées de Verrais", "au nord de Rogael", "chez les traducteurs", "contre les crues", "avec les riverains", "en trois étapes"]


def article(i):
    """Each page has an article of its own, as pages have."""
    import random

    rnd = random.Random(i)
    say = lambda: f"{rnd.choice(WHO)} {rnd.choice(DOES)} {rnd.choice(WHAT)} {rnd.choice(WHERE)}, {rnd.choice(['après', 'malgré', 'sans', 'avant'])} {rnd.choice(WHAT)} {rnd.choice(WHERE)}."
    return [say() + " " + say(), f"Rogael{i}, Silreand et {rnd.choice(WHAT)} {rnd.choice(WHERE)}", f"– {1000 * i + 7} {rnd.choice(['ateliers', 'bourses', 'postes', 'stages', 'classes'])} {rnd.choice(WHERE)} {rnd.choice(['avant', 'après', 'pendant'])} l'été", say() + " " + say()]


def pages():
    out = []
    for i in range(40):
        a = article(i)
        k = i % 4
        out.append("\n".join([AROUND[0], AROUND[1], "", *a[: k + 1], AROUND[3], "", *a[k + 1 :], *AROUND[4 + i % 3 :], AROUND[2]]))
    return out


def test_page_body(spark):
    texts = pages()
    df = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)] + [doc(None, texts[0]), doc(104, texts[0], kind=None), doc(100, None), doc(101, ""), doc(102, texts[0], kind="pdf"), doc(103, "\n \n")], DOCS)
    w = B.weights(df)
    got = {}
    for r in B.around(df, w).collect():
        got.setdefault(r["doc_id"], set()).add(r["line_no"])
    assert set(got) == set(range(40))
    for i, t in enumerate(texts):
        assert got[i] == {n for n, line in enumerate(t.split("\n"), 1) if line in AROUND}, i
    assert B.around(df.limit(0), w).count() == 0 and B.weights(df.limit(0)) == {}


def test_held_out_lines_in_other_spelling():
    w = B.train(pages())
    for line in AROUND:
        assert B.line_score(B.fold("  " + line.replace("é", "e\u0301").replace(" ", "  ")).strip(), w) < 0, line
    for line in ARTICLE:
        assert B.line_score(B.fold(line.upper()), w) > -B.OPENING, line


def test_labels_come_from_repetition():
    got = dict(B.labelled(pages()))
    assert not any(got.get(line) for line in AROUND) and sum(line in got for line in AROUND) >= 7
    assert all(got.get(line, True) for i in range(40) for line in article(i))
    # copies of one page repeat its article as well, so they count once
    copies = dict(B.labelled([*pages(), *[pages()[0]] * 100]))
    assert all(copies.get(line, True) for line in article(0))
    # a page whose lines no other page repeats has no line of the page around
    assert False not in dict(B.labelled(["\n".join(AROUND)])).values() and B.labelled([None, ""]) == []


def brute_regions(scores, opening):
    best = 0.0
    for mask in range(1 << len(scores)):
        inside = [bool(mask >> i & 1) for i in range(len(scores))]
        n = sum(x and (i == 0 or not inside[i - 1]) for i, x in enumerate(inside))
        best = max(best, sum(s for s, x in zip(scores, inside) if x) - opening * max(n - 1, 0))
    return best


def test_best_regions_match_brute_force():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        s = [float(rnd.randint(-4, 4)) for _ in range(rnd.randint(0, 9))]
        got = B.best_regions(s, 1.5)
        assert all(a < b for a, b in got) and all(x[1] < y[0] for x, y in zip(got, got[1:]))
        assert sum(sum(s[a:b]) for a, b in got) - 1.5 * max(len(got) - 1, 0) == brute_regions(s, 1.5), s


def test_filled_records_prove_a_slot(spark):
    # one value in many records: a default is found whatever their number, copies of a page change nothing
    many = [doc(i, f"Un mot. Rédigé par [Votre nom] pour Site{i}.") for i in range(5)]
    copies = [doc(10 + i, "La page du comité {nom_du_comite} ouvre demain.") for i in range(4)]
    assert found(spark, *many, *copies) == [0, 1, 2, 3, 4, 10, 11, 12, 13]
    # a variable that prose may cite as well: only records that fill its place tell
    cited = [doc(20 + i, f"Montant retenu par le jury : {{seuil}} euros à Port{i}.") for i in range(4)]
    assert found(spark, *cited) == []
    assert found(spark, *cited, doc(30, "Un article.\nMontant retenu par le jury : 4 500 euros à Verrais. La suite.")) == [20, 21, 22, 23]
    # the same words without the marks, or none at all, fill nothing
    assert found(spark, *cited, doc(31, "Montant retenu par le jury : seuil euros à Verrais."), doc(32, "Montant retenu par le jury : euros à Verrais.")) == []


@pytest.mark.parametrize("text", [
    "Bonjour %prenom%, merci.", "Écrit par %AUTHOR% ce jour.", "Rédigé par $NOM_AUTEUR pour le site.", "Voir $4_titre ci-dessous.", "401 - Authentification requise", "Code : 404.", "Page supprimée", "Vérifions que vous êtes humain.", "Erreur : 451",
    "Curabitur donec mauris praesent vivamus aliquam.", "Fin. NaN NaN", "a ##CHAMP## b", "a @@champ@@ b", "a *|FNAME|* b", "a &lt;TITRE&gt; b", "a null null b", "a <<champ>> b", "a __TITRE__ b", "a %%nom%% b", "a <?= $x ?> b", "a <% x %> b", "a #{x} b", "Le <DATE> à Paris.",
])
def test_every_pattern_reaches_the_text(spark, text):
    assert [c for c in R.candidates_of("Un article.\n" + text, None, R._automaton()) if c[2] > R.OPEN]


@pytest.mark.parametrize("mark", ["{seuil}", "[Lieu dit]", "<MONTANT du jour>", "XXX", "______", "........", "undefined", "NaN", "N/A", "TBD", "TODO", "FIXME"])
def test_every_weak_mark_reaches_the_text(mark):
    assert [c[2] for c in R.candidates_of(f"Un article. Le comité local retient {mark} pour la salle.", None, R._automaton())] != []


def test_blanks_count_where_a_slot_is_shown(spark):
    blank = [doc(1, "Signé par le maire ______ de la commune."), doc(2, "Signé par le maire .......... de la commune.")]
    assert found(spark, *blank) == []
    assert found(spark, *blank, doc(3, "Signé par le maire Paul Rogael de la commune.")) == [1, 2]
    assert found(spark, doc(4, "450 – 500 emplois sont en jeu."), doc(5, "Avant-propos du comité ........ 4")) == []


def test_repeated_whole_pages(spark):
    page = "Die angeforderte Seite wurde nicht gefunden.\nVorgang {}. Bitte später wiederkommen."
    pages = [doc(i, page.format(1000 + i)) for i in range(R.REPEATED)]
    assert found(spark, *pages) == list(range(R.REPEATED))
    assert found(spark, *pages[1:], doc(1, page.format(1))) == []
    # short texts of other content, and long ones, are not error pages for being repeated
    assert found(spark, *[doc(i, "Le conseil a voté le budget de la ville.") for i in range(30)]) == []
    assert found(spark, *[doc(i, page.format(i) + "\nUn long article." * 60) for i in range(30)]) == []


def test_bodies_of_pages_with_a_residue(spark, tmp_path):
    from quillon.llm.queries import queries

    texts = pages()
    rows = [doc(i, t + ("\nBonjour {{ prenom }}, merci de votre message." if i == 7 else "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries()["p5_bodies"](spark, str(tmp_path)).collect()}
    assert len(got) == 40 and got[7]["n_removed"] >= sum(line in AROUND for line in texts[7].split("\n"))
    assert not set(got[7]["text"].split("\n")) & set(AROUND)


def test_the_scan_decides_not_the_line():
    w = {"": 0.0, "phrase": 8.0, "titre": -0.5, "lien": -9.0, "peu": 1.0}
    # a heading within the article stays, a pointer within it is cut, a weak line far from it is cut, and so is a heading there
    assert B.page_lines("\n".join(["peu", "lien", "phrase", "titre", "phrase", "lien", "phrase", "lien", "titre"]), w) == [1, 2, 6, 8, 9]
    # by their signs alone the weak line would be kept and the heading cut
    assert B.page_lines("\n".join(["phrase", "titre", "phrase", "lien", "lien", "peu"]), w) == [4, 5, 6]
    assert B.page_lines("peu\nlien", w) == [2] and B.page_lines("lien", w) == [1] and B.page_lines("\n \n", w) == []


def test_bodies_in_one_pass(spark):
    texts = pages()
    df = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)] + [doc(100, None), doc(101, ""), doc(102, texts[0], kind="pdf")], DOCS)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in B.bodies(df, B.weights(df)).collect()}
    assert set(got) == {*range(40), 100, 101} and got[100] == (0, None) and got[101] == (0, "")
    for i, t in enumerate(texts):
        assert got[i][1] == "\n".join(x for x in t.split("\n") if x not in AROUND) and got[i][0] == sum(x in AROUND for x in t.split("\n"))


def test_notices_are_fitted_on_all_documents(spark):
    # a line that looks like a notice is common in 12 of 2,000 documents, whichever they are, and isn't in 9
    docs = [doc(i, "Un mot de la commune.") for i in range(2000)]
    for many in (12, 9):
        held = [doc(i, f"Cet article a été retiré par l'éditeur le {i} mai.") if i < many else d for i, d in enumerate(docs)]
        assert found(spark, *held) == ([] if many == 12 else list(range(many))), many


def test_words_are_counted_over_all_texts(spark):
    df = spark.createDataFrame([doc(i, "Le rapport cite la commune." if i % 100 else "Le rapport cite la passerelle.") for i in range(1000)] + [doc(None, "La passerelle.")], DOCS)
    c = R.candidates(df)
    assert {r["template"]: r["n"] for r in c.where(c["weight"] == R.WORDS).groupBy("template").agg({"head": "sum"}).withColumnRenamed("sum(head)", "n").collect()}.items() >= {("", 1000), ("passere", 10)}
    assert R.model(c)["passere"] < R.model(c.where("template <> 'passere'"))["passere"]


def test_ordinary_sentences_are_judged_without_costly_patterns(monkeypatch):
    held = ["Pour le maire de Saint-Ouen, « l'œuvre » de 2025 – la page – n’existe plus à 10 %.", "Le 3 mai, le serveur de Port-Ronoane a coûté 1 200 €…"]
    want = [N.features(s) for s in held]
    assert {"zname", "qq", "0", "page n", "existe plus"} <= want[0] and "uvre" not in want[0]
    judge = N.Judge(N.base(), clue=0.0)
    for name in ("_KEPT", "_PATH", "_CODE", "_TOKEN", "_LETTERS"):
        monkeypatch.setattr(N, name, None, raising=False)
    assert [N.features(s) for s in held] == want
    assert all(judge.score(s) > -10 for s in held)


@pytest.mark.parametrize("text", ["L’œuvre d'été – 404 pages", "ﬁn de nº 3", "ab–cd m² ½ x™ a\x85b", "Сайт недоступен, cooKie ſcript", "e\u0301te\u0301 a_b c0d ٣x", "İstanbul ŸÀ ß Ð µ ªº", ""])
def test_words_by_table_are_those_of_the_patterns(text, monkeypatch):
    by_table = [w for w in N.words_of(text) if w], N._tokens(text), N.features(text)
    monkeypatch.setattr(N, "_folded", lambda *_: None)
    assert by_table == ([w for w in N.words_of(text) if w], N._tokens(text), N.features(text))


def test_each_sentence_of_a_page_is_folded_once(monkeypatch):
    folded, words_of = [], N.words_of
    monkeypatch.setattr(N, "words_of", lambda text: folded.append(text) or words_of(text))
    judge = N.Judge(N.base(), clue=0.0)
    for text in pages():
        folded.clear()
        _, words = R.doubtful_of(text, "Un titre", judge)
        assert words == set(words_of(text)) and len(folded) <= len(set(R.all_sentences(text))) + 1
