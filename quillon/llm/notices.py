"""Notices of broken pages told from sentences of articles: a model of words, trained on sentences labelled by hand.

The labelled sentences are written for this purpose and taken from no table; common subjects and states are combined
into more of them. What is common in the corpus is added as ordinary text, counted over all its documents: sentences
that the labelled ones alone don't surely tell from notices, and single words (see `train`). Logistic regression over stems, pairs of stems and
the form of the sentence (names, numbers, status codes, quoted words and length put in their place).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

# Labelled by hand: notices. Each line has subjects, then states, which are combined; or sentences of their own.
COMBINED = [
    ("la page|cette page|la page demandée|le document|ce document|le fichier|l'article|cet article|la ressource|ce contenu|le contenu demandé",
     "n'existe pas|n'existe plus|est introuvable|n'est plus disponible|n'est pas disponible|a été supprimé|a été déplacé|a été retiré par l'éditeur|n'a pas pu être trouvé|est inaccessible pour le moment|a expiré"),
    ("page|document|fichier|article|contenu|ressource", "introuvable|non trouvée|indisponible|supprimé|inexistante|expirée"),
    ("le site|ce site|le service|notre service|la plateforme|Nordia|Le Quai des Brumes", "est en maintenance|est en cours de maintenance|est temporairement indisponible|est momentanément inaccessible|sera de retour bientôt|est fermé pour mise à jour"),
    ("le serveur|notre serveur|le serveur distant|la passerelle|la base de données", "ne répond pas|ne répond plus|a rencontré une erreur|a renvoyé une erreur interne|est surchargé|n'a pas répondu à temps|est injoignable"),
    ("votre session|votre lien|votre jeton|ce lien|votre connexion|votre abonnement d'essai", "a expiré|n'est plus valide|est arrivée à expiration, reconnectez-vous|a expiré, identifiez-vous encore"),
    ("votre adresse IP|votre navigateur|votre requête|votre accès|votre compte", "a été bloquée|est bloqué|a été refusée par le pare-feu|n'est pas autorisé|a été suspendu|n'est pas pris en charge"),
    ("ce site|cette page|cette application|l'application|Nordia|Le Quai des Brumes", "nécessite JavaScript|a besoin de JavaScript|requiert l'activation de JavaScript|exige que JavaScript soit activé|fonctionne uniquement avec JavaScript|ne peut pas s'afficher sans les scripts"),
    ("JavaScript|les scripts|l'exécution de scripts|les cookies", "est désactivé|sont désactivés|n'est pas activé dans votre navigateur|est requis pour afficher cette page|doivent être autorisés|sont bloqués par votre navigateur"),
    ("the page|this page|the requested page|the document|the file|this article|the content|the requested resource|the requested url", "does not exist|no longer exists|was not found|could not be found|is no longer available|has been removed|has been moved|is unavailable|cannot be displayed|has expired"),
    ("page|file|document|content|url|resource", "not found|unavailable|removed|expired|missing"),
    ("the site|this site|the service|our service|the server|this website", "is down for maintenance|is under maintenance|is temporarily unavailable|is currently unavailable|will be back soon|is overloaded|did not respond|returned an error|encountered an internal error|timed out"),
    ("your session|your link|this link|your token|your account", "has expired|is no longer valid|timed out|has been suspended"),
    ("your ip address|your request|your access|your browser|access to this page", "has been blocked|was blocked|has been denied|is not supported|was rejected by the firewall"),
    ("this site|this page|this app|the application", "requires JavaScript|needs JavaScript to run|works only with scripts enabled|requires scripts|does not work without JavaScript"),
    ("JavaScript|scripts|cookies", "is disabled|are disabled|is turned off in your browser|must be enabled|are required"),
    ("error|erreur|HTTP|code|statut|status", "400|401|403|404|410|429|500|502|503|504"),
    ("400|401|403|404|410|429|500|502|503|504", "not found|forbidden|bad request|gone|bad gateway|service unavailable|gateway timeout|internal server error|unauthorized|page introuvable|accès interdit|erreur interne|service indisponible|accès refusé"),
    ("le texte|votre texte|un paragraphe|le titre|une légende|une image|la description", "ici|à venir|à remplacer|à compléter|provisoire|par défaut"),
    ("your text|text|title|caption|description|paragraph", "here|goes here|to be replaced|placeholder|to come"),
]
NOTICES = """Accès refusé.
Accès interdit.
Accès bloqué
Accès non autorisé
Access denied
Forbidden
Unauthorized
Not found
Bad gateway
Gateway timeout
Service unavailable
Internal server error
Erreur interne du serveur
Erreur serveur
Erreur
Error
Oups !
Oups, une erreur est survenue.
Une erreur inattendue s'est produite.
Une erreur est survenue lors du chargement de la page.
An error occurred while processing your request.
Something went wrong.
Oops, nothing here.
Désolé, nous ne trouvons pas ce que vous cherchez.
Sorry, we can't find that page.
Il n'y a rien ici.
Aucun résultat à cette adresse.
Nothing was found at this location.
Vous n'avez pas l'autorisation d'accéder à cette page.
Vous n'avez pas les droits nécessaires pour consulter ce document.
You are not authorized to view this page.
You do not have permission to open this directory.
Veuillez activer JavaScript pour continuer.
Merci d'activer les scripts dans votre navigateur.
Activez JavaScript puis rechargez la page.
Please enable JavaScript to continue.
Enable cookies and reload the page.
You must enable scripts to use this site.
Pour afficher ce contenu, autorisez les scripts.
Pour consulter cette page, activez JavaScript dans les réglages.
Afin de poursuivre la lecture, veuillez autoriser l'exécution des scripts.
Noscript
Contenu masqué sans script
Si la page ne s'affiche pas, activez JavaScript.
Si rien ne s'affiche, rechargez la page.
If nothing is displayed, reload the page.
Chargement…
Chargement de la page en cours
Loading...
Loading, please wait
Un instant...
Just a moment...
Un instant, nous vérifions votre navigateur.
Please wait while we check your browser.
Checking your browser before accessing the site.
Vérification de sécurité en cours.
Vérifiez que vous êtes humain.
Confirmez que vous n'êtes pas une machine.
Verify you are human.
Attention required!
Complete the captcha to continue.
Cochez la case pour montrer que vous êtes humain.
Trop de requêtes, réessayez plus tard.
Too many requests
Please try again later.
Réessayez dans quelques instants.
Merci de revenir plus tard.
Veuillez vous reconnecter pour continuer.
Please log in again.
Session expirée
Session expired
Maintenance en cours
En maintenance
Site en maintenance
Maintenance programmée, retour prévu à 18 h.
Scheduled maintenance
Nos techniciens travaillent à rétablir le service.
Our engineers are working on the problem.
Impossible d'afficher cette page.
Impossible de se connecter au serveur.
Impossible de charger le contenu demandé.
Unable to connect to the database.
Cannot connect to the server.
Error establishing a database connection
Connexion à la base de données impossible.
Échec de la connexion au serveur SQL
Fatal error
Fatal error: out of memory in index.php on line 12
Warning: include() failed in header.php on line 3
Notice: undefined variable in template.php on line 40
Parse error: unexpected token
Uncaught exception: not found
Traceback (most recent call last)
Stack trace
Request timed out
Requête expirée
Délai d'attente dépassé pour la passerelle.
The proxy server received an invalid response.
Request id 8f2a-11
Incident 20250-77
Cet article a été dépublié à la demande de son auteur.
Ce texte a été retiré à la demande de l'intéressé.
This video has been removed by the user.
Retiré pour des raisons juridiques.
Contenu supprimé
Page supprimée
Page expirée
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Pour voir « la vidéo du soir », activez JavaScript.
Votre session a expiré, identifiez-vous pour ouvrir « le dossier des eaux ».
Texte provisoire
Paragraphe provisoire à remplacer (Rouval, Tessy).
Texte à remplacer avant publication
Texte d'exemple
Texte factice
Texte de remplissage pour la maquette
Ceci est un texte d'exemple.
Sample text
Dummy content
This is placeholder text.
Insérez votre texte ici.
Insert your text here
Saisissez ici le contenu du bloc.
Bloc de texte : deux lignes attendues
Contenu à venir
Coming soon
Page en construction
Under construction
Titre de l'article
Titre de page
Titre
Sans titre
Untitled
Untitled document
Page title
New page
Nouvelle page
Titre – modèle
Hello world!"""  # fmt: skip
# Labelled by hand: sentences and lines of good pages that hold the same words.
ORDINARY = """Le maire a reconnu que le site de la commune était en maintenance depuis trois semaines.
La députée rappelle que le service en ligne exige JavaScript, ce qui écarte des usagers.
Des habitants ont trouvé une « page introuvable » en cherchant le formulaire.
La mention « accès interdit » s'affichait sur les postes de la mairie, selon le rapport.
Une erreur de calcul a coûté deux millions d'euros à la région.
L'erreur serait de croire que la machine décide seule.
Le serveur de la bibliothèque consomme moins d'eau que prévu.
Les serveurs du centre de données seront refroidis à l'eau de mer.
L'accès aux données de santé sera refusé aux assureurs.
L'accès au fonds est réservé aux communes rurales.
Le rapporteur a compté six mille cookies déposés sans accord par la plateforme.
L'autorité a bloqué le service pendant deux mois.
Le contrat a expiré en mars et n'a pas été renouvelé.
La page est tournée, assure le ministre.
Cette page de l'histoire industrielle se referme.
La maintenance des trains sera confiée à un prestataire.
La maintenance prédictive réduit les pannes, dit l'ingénieure.
Le service public ne peut pas fermer à dix-huit heures.
Le document a été remis à la commission mardi.
Le texte a été retiré de l'ordre du jour par le gouvernement.
L'amendement a été supprimé en séance.
La proposition a été retirée à la demande de la majorité.
Le titre de champion lui a échappé.
Votre message du 3 mai a bien été reçu par le cabinet.
Votre commune a besoin de vous.
Un robot ne remplacera pas un soignant, dit-elle.
Prouver que l'on n'est pas un robot prend parfois dix minutes, s'amuse le sénateur.
Le site compte trois cents agents et deux ateliers.
Ce site industriel est fermé depuis 2019.
The minister said the website was down for maintenance during the vote.
The server farm needs more water than planned.
The error was found by an auditor in May.
Access to the register was denied to two reporters.
The page turned quickly for the former mayor.
A study found that forty sites require cookies.
The service is available in twelve languages.
The document was removed from the agenda on Monday.
Scripts written by pupils were shown at the fair.
Le code de conduite sera signé par 404 entreprises.
Quelque 500 agents seront formés avant l'été.
503 communes ont répondu au questionnaire.
Plus de 400 pages de rapport pour une seule recommandation.
Ce site utilise des cookies pour mesurer son audience.
Nous utilisons des cookies pour améliorer votre expérience.
En poursuivant votre navigation, vous acceptez l'usage de cookies.
Nos partenaires lisent des informations sur votre appareil.
Gérer les cookies
Accepter tout
Continuer sans accepter
Votre navigateur garde vos choix pendant six mois.
Mentions légales | Plan du site | Accessibilité : partielle | Contact
Copier le lien
Envoyer à un ami
Accueil
Mon compte · Mes alertes · Déconnexion
Se connecter
S'abonner
Rechercher sur le site
Retour en haut de page
Page suivante
Page 2 sur 7
Imprimer la page
Partager cet article
Lire la suite
La suite après cette publicité
Temps de lecture : 4 min
Publié le 3 mai 2025 à 10:15, mis à jour à 11:02
Tous droits réservés.
Reproduction interdite sans accord écrit.
Par la rédaction
Inscrivez-vous à notre lettre d'information.
Saisissez votre adresse pour recevoir la lettre.
Chargez l'application sur votre téléphone.
Contenu sponsorisé
Sommaire
Document joint
Article précédent
Vous avez aimé cette page ? Faites-la circuler.
Comments are closed.
Share this article
Skip to content
All rights reserved.
Please read our privacy policy.
Merci de votre confiance.
Merci, je vous en prie.
Attention, dit-il, la loi ne suffira pas.
Un instant de silence a suivi.
Rien n'est réglé pour les communes.
Rien ne change pour les retraités.
Le lien entre emploi et formation reste faible.
La session parlementaire s'achève vendredi.
La session a été levée à minuit.
Le compte n'y est pas, dit le syndicat.
La demande a été refusée par le préfet.
Sa requête a été rejetée par le tribunal.
Le formulaire est disponible en mairie.
Un article.
Un autre article.
L'article du jour
Une page de notes
Un texte court.
Un autre texte.
Le document joint
Un titre
Un autre titre
Le fichier des électeurs
Une erreur de jeunesse
Erreur de calcul au conseil régional
L'erreur du ministre
Erreur d'aiguillage pour le budget
410 – 420 habitants sont concernés.
Entre 400 et 500 postes sont en jeu.
403 emplois ont été supprimés.
Titre de gloire
La séance est ouverte.
La séance est levée à midi.
Les travaux sont suspendus jusqu'à lundi.
L'audience a été suspendue puis reprise.
Programme du parti – page 2
Document de campagne
Rechercher sur Nordia
retour en haut de page
The council rejected the levy on Monday, without giving a date.
In a letter, the mayor asked to review the plan for small firms.
The unions and the minister disagree on the pilot scheme.
After weeks of delay, the committee postponed the audit.
For the spokesperson, a code of conduct comes first.
The adviser endorsed a tax credit for hospitals before the vote.
Speaking to reporters, the senator defended the open register.
This week, the region put forward a new training path.
The candidate described a public fund without naming a price.
The foundation outlined a spending cap, despite doubts in the north."""  # fmt: skip

_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"")
_PATH = re.compile(r"\S*[/\\]\S+|\S*\d\S*-\S+|\S+-\S*\d\S*|\S+\.(?:example|php|html?|fr|com|org)\b\S*")
_CODE = re.compile(r"(?<![\d\s])\s*\b[45]\d\d\b(?!\s*\d)|^\s*[45]\d\d\b(?!\s*\d)")
_NUMBER = re.compile(r"\d[\d\s.,:]*\d|\d")
_DIGIT, _DOT, _DASHED, _HUNDREDS = re.compile(r"\d"), re.compile(r"\.[ephfco]"), re.compile(r"\d\S*-|-\S*\d"), re.compile(r"[45]\d\d")
# what stands before is looked at after the first letter: capitals are found fast
_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ](?<=[\w,;:»)’'] [A-ZÀ-ÖØ-Þ])[\w'’-]*(?:\s(?:(?:de|du|des|la|le)\s)*[A-ZÀ-ÖØ-Þ][\w'’-]*)*")
#: A name of several words at the beginning; a single word there may be any.
_FIRST = re.compile(r"^\W*(?:[LD]['’])?[A-ZÀ-ÖØ-Þ][\w'’-]*(?:\s(?:(?:de|du|des|la|le)\s(?:l['’])?|d['’])?[A-ZÀ-ÖØ-Þ][\w'’-]*)+")
#: Names of techniques that are words of notices, not names.
_KEPT = re.compile(r"(?i)\b(?:javascript|ip|http|url|sql|php|captcha|cookies?|scripts?)\b")
#: Parts of which every name of _KEPT, in lower case, holds at least one; or a letter that counts as i or s there.
_IN_KEPT = ("ip", "http", "url", "sql", "php", "captcha", "cookie", "ı", "i\u0307", "ſ")
_TOKEN = re.compile(r"[^\W\d_]+|0")
_LETTERS = re.compile(r"[^\W\d_]+")
STATUS = re.compile(r"[45](?<!\w[45])\d\d\b")
#: Letters of a word that are compared; words of a short notice.
STEM, SHORT = 7, 3


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def _folds(page: str, apart: bool) -> tuple[bytes, bytes]:
    """What each character of a code page is folded to, and those that are deleted; ODD for those that the patterns must decide on.

    apart: whether signs that have no plain form part words, as in `words_of`, or are deleted first, as in `_tokens`.
    """
    to, deleted = bytearray(b" " * 256), bytearray()
    for k in range(256):
        ch = bytes([k]).decode(page, "replace")
        plain = _plain(ch)
        if apart and not _LETTERS.fullmatch(ch):
            continue
        if plain == "":
            deleted.append(k)
        elif len(plain) == 1 and (apart or _TOKEN.fullmatch(plain)):
            to[k] = ord(plain)
        elif apart or _TOKEN.search(plain):
            to[k] = ODD
    return bytes(to), bytes(deleted)


#: Code pages that hold French and English letters and signs, one byte each; the first is read faster, the second has more signs.
PAGES, ODD = ("latin-1", "cp1252"), 1
_GLUED, _APART = [[(p, _folds(p, apart)) for p in PAGES] for apart in (False, True)]


def _folded(text: str, pages: list[tuple[str, tuple[bytes, bytes]]]) -> list[str] | None:
    """The words of a text, all its characters folded in one pass by a table; None where no table tells."""
    for page, folds in pages:
        try:
            got = text.encode(page).translate(*folds)
        except UnicodeEncodeError:
            continue
        return None if ODD in got else got.decode("ascii").split()
    return None


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in plain lower case."""
    got = _folded(text, _APART)
    return [_plain(w) for w in _LETTERS.findall(text.lower())] if got is None else got


def _tokens(text: str) -> list[str]:
    got = _folded(text.replace("0", " 0 ") if "0" in text else text, _GLUED)
    return _TOKEN.findall(_plain(text)) if got is None else got


def parts(sentence: str) -> tuple[list[str], set[str]]:
    """(stems in their order, form of a sentence and what it begins with)."""
    if sentence.isupper() and len(sentence) > 30:
        sentence = sentence.capitalize()  # names cannot be told in capitals
    t = sentence.replace("’", "'")
    # most sentences have nothing of the kind, which is found out at less cost than by the patterns
    if any(map(t.lower().__contains__, _IN_KEPT)):
        t = _KEPT.sub(lambda m: m.group().lower(), t)
    numbers = _DIGIT.search(t) is not None
    if "«" in t or '"' in t or "“" in t:
        t = _QUOTED.sub(" Qq ", t)
    if "/" in t or "\\" in t or (numbers and "-" in t and _DASHED.search(t)) or _DOT.search(t):
        t = _PATH.sub(" zpath ", t)
    if numbers and _HUNDREDS.search(t):
        t = _CODE.sub(" zcode ", t)
    first = _FIRST.match(t)
    if first:
        t = "zname" + t[first.end() :]
    t, n_names = _NAME.subn("zname", t)
    n_names += first is not None
    if numbers:
        t = _NUMBER.sub(" 0 ", t)
    words = [w[:STEM] for w in _tokens(t)]
    n = len(words)
    out = {"<1>" if n <= 1 else "<2-3>" if n <= 3 else "<4-7>" if n <= 7 else "<8-12>" if n <= 12 else "<13-20>" if n <= 20 else "<21->"}
    out.add("<names>" if n_names > 1 else "<name>" if n_names else "<none>")
    if words:
        out.add("^" + words[0])
        out.add("^" + " ".join(words[:2]))
    return words, out


def features(sentence: str) -> set[str]:
    """Stems, pairs of them and the form of a sentence."""
    words, out = parts(sentence)
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), *out}


def labelled() -> list[tuple[str, bool]]:
    out = [(x, True) for x in NOTICES.split("\n")] + [(x, False) for x in ORDINARY.split("\n")]
    for subjects, states in COMBINED:
        for s in subjects.split("|"):
            out += [(s[:1].upper() + s[1:] + " " + x + ("." if len(x) > 12 else ""), True) for x in states.split("|")]
    return out


def _fit(rows: list[tuple[set[str], bool]], rounds: int = 150, ridge: float = 2e-5) -> dict[str, float]:
    names: dict[str, int] = {}
    ids, at, y = [], [], []
    for said, notice in rows:
        got = [names.setdefault(f, len(names)) for f in sorted(said)]
        ids += got
        at += [len(y)] * len(got)
        y.append(notice)
    i, r, t = np.array(ids), np.array(at), np.array(y, float)
    share = np.where(t > 0, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1))
    w, bias = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(r, w[i], len(t)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * share
        g = np.r_[np.bincount(i, d[r], len(w)) + ridge * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return {"": round(float(bias), 3)} | {f: round(float(w[k]), 3) for f, k in names.items() if abs(w[k]) >= 0.02}


@lru_cache(1)
def base() -> dict[str, float]:
    """The model of the labelled sentences alone."""
    return _fit([(features(s), notice) for s, notice in labelled()])


@lru_cache(1)
def stems() -> frozenset[str]:
    """The stems of the labelled sentences, of which the documents are counted; without those of notices of SHORT words or
    less, which are labelled as telling a notice nearly by themselves, however common they are."""
    short = (_TOKEN.findall(_plain(s)) for s, notice in labelled() if notice)
    return frozenset(f for s, _ in labelled() for f in features(s) if f[0] not in "^<" and " " not in f) - {w[:STEM] for words in short if len(words) <= SHORT for w in words}


class _Clue(dict):
    """Whether a word speaks for a notice, found out once a word."""

    def __init__(self, w: dict[str, float], clue: float):
        super().__init__()
        self.stems = {f for f, x in w.items() if x >= clue and len(f) > 3 and f.isalpha()}

    def __missing__(self, word: str) -> bool:
        out = word[:STEM] in self.stems
        if len(self) < 100_000:
            self[word] = out
        return out


class Judge:
    """Sentences in, log-odds of being a notice out; clue: the least weight of a word that speaks for one."""

    def __init__(self, w: dict[str, float], clue: float | None = None):
        self.w = w
        self.pairs = {(a, b): x for f, x in w.items() if f[:1] != "^" for a, sep, b in [f.partition(" ")] if sep}
        self.clue = _Clue(w, CLUE if clue is None else clue)
        self.known: dict[str, float] = {}

    def speaks(self, sentence: str, words: list[str]) -> bool:
        """Whether any word speaks for a notice."""
        return any(map(self.clue.__getitem__, words)) or STATUS.search(sentence) is not None

    def score(self, sentence: str, words: list[str] | None = None) -> float:
        """Without a word that speaks for it, or longer than LONGEST, a sentence is no notice; words: those of `words_of`."""
        if len(sentence) > LONGEST:
            return -10.0
        got = self.known.get(sentence)
        if got is None:
            got = self._score(sentence, words_of(sentence) if words is None else words)
            if len(sentence) <= 120 and len(self.known) < 100_000:
                self.known[sentence] = got
        return got

    def _score(self, sentence: str, words: list[str]) -> float:
        if not self.speaks(sentence, words):
            return -10.0
        # a title in capital letters looks like a name, so it is judged without them as well
        forms = (sentence, sentence.lower()) if len(sentence) < 40 else (sentence,)
        return self.w[""] + max(map(self._sum, forms))

    def _sum(self, sentence: str) -> float:
        """The weights of the sentence's features, each counted once."""
        words, form = parts(sentence)
        form.update(words)
        return sum(map(self.w.__getitem__, self.w.keys() & form)) + sum(map(self.pairs.__getitem__, self.pairs.keys() & set(zip(words, words[1:]))))


def train(sentences: list[str], words: list[str]) -> dict[str, float]:
    """The model with ordinary text beside the labelled sentences: the sentences and the stems that stand in COMMON of the documents or
    more, as no notice does and as no word does that tells a notice by itself."""
    rows = [(features(s), notice) for s, notice in labelled()] + [(features(s), False) for s in sentences] + [({x}, False) for x in words]
    return _fit(rows)


#: Share of the documents that no notice stands in; log-odds by the labelled sentences alone below which a sentence is surely none; weight of a word that speaks for one.
COMMON, SURELY_NOT, CLUE = 0.005, -1.5, 0.3
#: Longest notice, in characters.
LONGEST = 300


def form(sentence: str) -> str:
    words, out = parts(sentence)
    return " ".join(sorted({*words, *(f for f in out if " " not in f)}))
