"""Fixed phrase lists for page furniture and residue, in de/en/es/fr/it.

Phrases are written in plain spelling.  ``*`` stands for any text, ``0`` for
any run of digits.  They are compared on :func:`skeleton` keys, which keep
only ASCII characters, so that a wrongly decoded line still meets its phrase.
"""

from __future__ import annotations

import re

import ahocorasick

_DIGITS = re.compile(r"[0-9]+")
_SPACES = re.compile(r"[\s\x00-\x1f]+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


#: Digits as 0 and white space as a space, byte by byte.
_FOLDED = bytes(48 if 48 <= i < 58 else 32 if 9 <= i < 14 or 28 <= i < 32 else i for i in range(256))


def skeleton(line: str) -> str:
    """Lower-cased ASCII part of a line, runs of digits as 0, single spaces."""
    key = line.lower().encode("ascii", "ignore").translate(_FOLDED)
    while b"00" in key:
        key = key.replace(b"00", b"0")
    while b"  " in key:
        key = key.replace(b"  ", b" ")
    return key.strip(b" ").decode()


#: Labels of menus, buttons and footers: a whole line or a whole menu entry.
LABELS = """
Accueil; Nos offres; Tarifs; Actualités; Recrutement; Études; Espace client; Mon compte; Particuliers;
Professionnels; Nous contacter; Qui sommes-nous; Aide et questions; Trouver une agence; Plan du site; Newsletter;
Se connecter; Connexion; Entreprises; Contact; Contacts; Services; Blog; FAQ; Menu; Rechercher;
Accepter; Refuser; Fermer; Tout accepter; Tout refuser; Imprimer; Copier le lien; Partager; Partager cet article;
Envoyer par courriel à un ami; Ajouter à mes favoris; Je m’inscris; S’abonner; Votre adresse électronique;
Haut de page; Retour en haut; Conditions générales d’utilisation; Mentions légales; Données personnelles; Accessibilité;
Gérer mes préférences de confidentialité;
Home; Our offers; Pricing; News; Careers; Research; My account; Personal; Business; Contact us; About us;
Help centre; Find a branch; Site map; Sign in; Log in; Search;
Accept; Decline; Reject; Close; Accept all; Reject all; Print; Copy link; Share; Share this article;
Email this to a friend; Add to my favourites; Sign me up; Subscribe; Your email address; Back to top;
General terms of use; Legal notice; Personal data; Accessibility; Manage my privacy choices;
Startseite; Unsere Angebote; Preise; Aktuelles; Karriere; Studien; Mein Konto; Privatkunden; Geschäftskunden;
Kontakt; Über uns; Hilfe und Fragen; Filiale finden; Übersicht; Anmelden; Rundbrief;
Annehmen; Ablehnen; Schließen; Alle annehmen; Alle ablehnen; Drucken; Link kopieren; Teilen; Artikel teilen;
Per E-Mail an Freunde senden; Zu meinen Favoriten hinzufügen; Jetzt eintragen; Abonnieren; Ihre E-Mail-Adresse;
Nach oben; Allgemeine Geschäftsbedingungen; Impressum; Datenschutz; Barrierefreiheit;
Meine Datenschutz-Einstellungen verwalten;
Inicio; Nuestras ofertas; Tarifas; Noticias; Empleo; Estudios; Área de cliente; Mi cuenta; Particulares; Empresas;
Contacto; Quiénes somos; Ayuda y preguntas; Buscar oficina; Mapa del sitio; Iniciar sesión; Boletín;
Aceptar; Rechazar; Cerrar; Aceptar todo; Rechazar todo; Imprimir; Compartir; Compartir este artículo; Copiar enlace;
Enviar por correo a un amigo; Añadir a mis favoritos; Quiero apuntarme; Suscribirse; Su correo electrónico;
Volver arriba; Condiciones generales de uso; Aviso legal; Datos personales; Accesibilidad;
Gestionar mis preferencias de privacidad;
Pagina iniziale; Le nostre offerte; Prezzi; Notizie; Lavora con noi; Studi; Area clienti; Il mio conto; Privati; Imprese;
Contatti; Chi siamo; Aiuto e domande; Trova filiale; Mappa del sito; Accedi; Bollettino;
Accetta; Rifiuta; Chiudi; Accetta tutto; Rifiuta tutto; Stampa; Copia il collegamento; Condividi;
Condividi questo articolo; Invia per posta a un amico; Aggiungi ai preferiti; Mi iscrivo; Iscriviti; Il tuo indirizzo di posta;
Torna su; Condizioni generali d’uso; Note legali; Dati personali; Accessibilità; Gestisci le mie preferenze sulla riservatezza
"""

#: Heads of boxes that refer to other pages.
RELATED = """
Les plus lus; Sur le même thème; À lire aussi; Nos autres dossiers; Articles liés; Voir aussi;
Read also; Most read; On the same topic; Our other reports; Related articles; See also;
Lesen Sie auch; Meistgelesen; Zum selben Thema; Unsere anderen Dossiers; Weitere Dossiers; Unsere weiteren Dossiers; Siehe auch; Mehr zum Thema;
Lea también; Lo más leído; Sobre el mismo tema; Otros informes; Nuestros otros informes; Véase también;
Leggi anche; I più letti; Sullo stesso tema; Altri dossier; Altri approfondimenti; I nostri altri dossier; Altri rapporti; Vedi anche
"""

#: Whole lines that belong to the frame of a page.
FRAME = """
*nous utilisons des cookies*; *traceurs*; *stockons des informations sur votre appareil*; *votre vie privée compte*;
*usage de traceurs*; *we use cookies*; *this site sets trackers*; *advertising trackers*; *store information on your device*;
*your privacy matters*; *wir verwenden cookies*; *setzt tracker*; *werbe-trackern*; *speichern informationen auf ihrem ger*;
*ihre privatsph*; *utilizamos cookies*; *rastreadores*; *guardamos información en su dispositivo*; *su privacidad importa*;
*usiamo i cookie*; *installa traccianti*; *uso di traccianti*; *conserviamo informazioni sul tuo dispositivo*; *la tua riservatezza conta*;
par la rédaction de *; publié le 0/0/0*; mis à jour le 0/0/0*; temps de lecture*; propos recueillis par *; par * le 0/0/0;
by the * newsroom; published on 0/0/0*; updated on 0/0/0*; 0 min read; reading time*; interview by *;
von der redaktion *; veröffentlicht am 0/0/0*; geändert am 0/0/0*; aktualisiert am 0/0/0*; lesezeit*; das gespräch führte*;
por la redacción de *; publicado el 0/0/0*; actualizado el 0/0/0*; tiempo de lectura*; entrevista del equipo*; entrevista de *;
a cura della redazione*; della redazione di *; dalla redazione di *; pubblicato il 0/0/0*; aggiornato il 0/0/0*; tempo di lettura*; intervista *;
suivez * sur les réseaux; suivez * sur *; follow *; folgen sie *; siga a *; segui *;
cet article vous a-t-il été utile*; was this page helpful*; war diese seite hilfreich*; *le ha resultado útil esta página*; questa pagina è stata utile*;
abonnez-vous*; recevez chaque semaine*; subscribe for free*; get the weekly letter*; kostenlos abonnieren*; jede woche der rundbrief*;
suscríbase*; reciba cada semana*; iscriviti gratis*; ricevi ogni settimana*;
mots-clés*; mots clés*; tags : *; tags: *; keywords*; schlagwörter*; stichwörter*; palabras clave*; etiquetas*; parole chiave*;
toute reproduction*; *décline toute responsabilité*; les informations publiées par*; (c) 0*; un site édité par*; * société au capital de*;
service client*0*; avant de signer un crédit*; un placement qui a bien marché*;
no part of this page may be copied*; *accepts no liability*; the information published by*; a site published by*; *is a company registered in*;
customer service*0*; before you sign for a loan*; an investment that did well*;
jede vervielfältigung*; *haftet nicht für fehler*; die angaben von * sind unverbindlich*; eine seite von *; * sitz in *stammkapital*;
kundendienst*0*; gehen sie vor der unterschrift*; was gestern gut lief*;
queda prohibida la reproducción*; *no se hace responsable*; la información publicada por*; un sitio editado por*; *capital de 0 0*;
atención al cliente*0*; antes de firmar un crédito*; una inversión que ayer fue bien*;
è vietata la riproduzione*; *non risponde di errori*; le informazioni pubblicate da*; un sito pubblicato da*; * società *capitale*; * capitale di 0 0*; *s.p.a.*capitale*;
servizio clienti*0*; prima di firmare un prestito*; un investimento andato bene ieri*;
*tous droits réservés*; *all rights reserved*; *alle rechte vorbehalten*; *todos los derechos reservados*; *tutti i diritti riservati*;
mentions légales *; legal notice *; impressum *; aviso legal *; note legali *
"""

#: Messages of servers and browsers that can stand in place of an article.
MESSAGES = """
veuillez activer javascript*; merci d’activer javascript*; *n’exécute pas les scripts*; *nécessite l’exécution de scripts*; *autorisez les scripts*;
please enable javascript*; enable javascript*; *doesn’t run scripts*; *need to allow scripts*; *allow scripts in your browser*;
bitte aktivieren sie javascript*; aktivieren sie javascript*; *führt keine skripte aus*; *ausführung von skripten*; *erlauben sie skripte*; *müssen skripte erlaubt sein*; *skripte in ihrem browser*; *skripte ausführen*; *skripte zulassen*;
active javascript*; *no ejecuta scripts*; *necesita ejecutar scripts*; *permita los scripts*;
attiva javascript*; *non esegue gli script*; *richiede l’esecuzione di script*; *consenti gli script*;
erreur 0*; *page demandée est introuvable*; *erreur interne est survenue*; *session a expiré*; *accès refusé*; *service est * indisponible*; *service est momentan*; *en maintenance*; *page introuvable*;
error 0*; error code: 0; http 0*; 0 not found; 0 forbidden; 0 bad gateway; 0 internal server error; 0 service unavailable; 0 gateway timeout; nginx; noscript; *page you asked for can’t be found*; *internal error occurred*;
*session has expired*; access denied*; *temporarily down for maintenance*;
fehler 0*; *angeforderte seite*nicht gefunden*; *interner fehler ist aufgetreten*; *sitzung ist abgelaufen*; zugriff verweigert*; *wegen wartung*; *wartungsarbeiten*;
*no se encuentra la página solicitada*; *se ha producido un error interno*; *sesión ha caducado*; acceso denegado*; *por mantenimiento*; *en mantenimiento*;
errore 0*; *pagina richiesta non è stata trovata*; *si è verificato un errore interno*; *sessione è scaduta*; accesso negato*; *per manutenzione*; *in manutenzione*;
*serveur met trop de temps*; *aucun résultat ne correspond à votre recherche*; *page n’existe plus*;
*server took too long*; *need to allow scripts*; *no results match your search*; *page no longer exists*; *this site can’t be reached*; sqlstate[*; warning: include(*; gateway time-out*; service unavailable*; request id *; traceback (most recent call last)*; java.*exception*; *fatal error: *; loading...; loading…;
undefined index: *; undefined variable*; undefined offset*; notice: undefined *; parse error: *; connection timed out*; connection refused*; connection reset*; too many requests*; bad request*;
*not available in your region*; *not available in your country*; *complete the captcha*; *verify you are human*; *verify that you are not a robot*; checking your browser*; you have been blocked*; database error*; *error establishing a database connection*; bandwidth limit exceeded*; account suspended*;
*server antwortet nicht rechtzeitig*; *ihrer suche gibt es keine treffer*; *diese seite gibt es nicht mehr*;
*servidor tarda demasiado*; *ningún resultado coincide con su búsqueda*; *página ya no existe*;
*server impiega troppo tempo*; *nessun risultato corrisponde alla tua ricerca*; *pagina non esiste più*
"""

#: Texts that stand for content still to be written.
FILLERS = """
*insérer le texte ici*; *insert text here*; *text hier einfügen*; *hier text einfügen*; *insertar el texto aquí*; *insertar texto aquí*; *inserire il testo qui*; *inserire qui il testo*; *inserte el texto aquí*; *inserisci*il testo*;
texte à compléter; text to be completed; text folgt noch; texto pendiente; testo da completare;
*xxx à renseigner xxx*; *xxx to be filled in xxx*; *xxx bitte ausfüllen xxx*; *xxx por rellenar xxx*; *xxx da compilare xxx*;
*[nom du produit]*; *[product name]*; *[name of the product]*; *[produktname]*; *[nombre del producto]*; *[nome del prodotto]*;
ajoutez une description de la rubrique*; add a description of this section*; *beschreibung der rubrik*; *beschreibung dieses bereichs*; añada una descripción de la sección*; *una descripción de la sección*; aggiungi una descrizione della sezione*;
votre titre ici*; your title here*; ihr titel hier*; su título aquí*; il tuo titolo qui*; lorem ipsum*
"""

#: Notes to the author that count anywhere in a line, in this spelling.
NOTES = """
xxx à renseigner xxx; xxx to be filled in xxx; xxx bitte ausfüllen xxx; xxx por rellenar xxx; xxx da compilare xxx;
TEXTE À COMPLÉTER; TEXT TO BE COMPLETED; TEXT FOLGT NOCH; TEXTO PENDIENTE; TESTO DA COMPLETARE;
[insérer le texte ici]; [insert text here]; [Text hier einfügen]; [inserte el texto aquí]; [inserire il testo qui]; [inserisci qui il testo];
[nom du produit]; [product name]; [Produktname]; [nombre del producto]; [nome del prodotto]
"""

#: Names of fields that templates put in plain brackets.
FIELDS = frozenset(
    "amount author city content date email link name page price product rate section subject summary title url user value year".split()
)

#: Filler prose is written in this fixed word list.
LATIN_FILLER = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum
    fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim laborum mauris
    vitae porttitor rhoncus tellus""".split()
)


def _items(block: str) -> list[str]:
    return [x for x in (" ".join(p.split()) for p in block.split(";")) if x]


class Phrases:
    """Whole-line test of a skeleton against the phrases of several lists, the earlier list first.

    Phrases with a fixed beginning are found by its first letters, the others by one
    automaton over their longest fixed parts; only then is a pattern tried.  The fixed parts of
    a phrase must make up a part of the line, a larger one if it may stand anywhere.
    """

    HEADS = 7, 3, 1
    HEAD_PART, INSIDE_PART = 24, 7

    def __init__(self, blocks: list[str]):
        self.by_head: dict[str, list[tuple[int, int, re.Pattern[str]]]] = {}
        inside: dict[str, list[tuple[int, int, re.Pattern[str]]]] = {}
        for number, block in enumerate(blocks):
            for phrase in _items(block):
                parts = [skeleton_part(p) for p in _trimmed(phrase).split("*")]
                if not any(p.strip() for p in parts):
                    continue
                pattern, letters = re.compile(".*".join(map(re.escape, parts)) + "$"), sum(map(len, parts))
                if parts[0]:
                    head = parts[0][: next(n for n in self.HEADS if len(parts[0]) >= n)]
                    self.by_head.setdefault(head, []).append((number, self.HEAD_PART * letters, pattern))
                else:
                    inside.setdefault(max(parts, key=len), []).append((number, self.INSIDE_PART * letters, pattern))
        self.automaton = ahocorasick.Automaton()
        for part, patterns in inside.items():
            self.automaton.add_word(part, patterns)
        self.automaton.make_automaton()

    def may(self, key: str) -> bool:
        """Whether any phrase can stand in a key."""
        return key[:7] in self.by_head or key[:3] in self.by_head or key[:1] in self.by_head or next(self.automaton.iter(key), None) is not None

    def number(self, key: str) -> int | None:
        """Number of the first list with a phrase that is the whole key."""
        found = None
        for head in (key[:7], key[:3], key[:1]):
            for number, longest, pattern in self.by_head.get(head, ()):
                if (found is None or number < found) and longest >= len(key) and pattern.match(key):
                    found = number
        for _, patterns in self.automaton.iter(key):
            for number, longest, pattern in patterns:
                if (found is None or number < found) and longest >= len(key) and pattern.match(key):
                    found = number
        return found


def _trimmed(phrase: str) -> str:
    """A phrase without the letters at its ends that no skeleton keeps."""
    return re.sub(r"^[^\x00-\x7f]+\s+|\s+[^\x00-\x7f]+$", "", phrase)


def skeleton_part(text: str) -> str:
    """Skeleton that keeps single spaces at both ends."""
    return _SPACES.sub(" ", _DIGITS.sub("0", _NON_ASCII.sub("", text.lower())))


LABEL_KEYS = frozenset(skeleton(x) for x in _items(LABELS))
RELATED_KEYS = frozenset(skeleton(x) for x in _items(RELATED))
#: Messages are tried before fillers, and these before phrases of the frame.
PHRASES = Phrases([MESSAGES, FILLERS, FRAME])


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word in words:
        made.add_word(word, True)
    made.make_automaton()
    return made


_NOTE_AUTOMATON = _automaton([_NON_ASCII.sub("", x) for x in _items(NOTES)])
_MARKS_AUTOMATON = _automaton([skeleton(x) for x in _items(NOTES)] + [w for w in LATIN_FILLER if len(w) > 4])
_LATIN_AUTOMATON = _automaton([w for w in LATIN_FILLER if len(w) > 4])  # one of these is in any line that is mostly of the filler's words


def has_note(line: str) -> bool:
    """A note to the author stands in the line; letters outside ASCII are left out of the comparison."""
    bare = line if line.isascii() else line.encode("ascii", "ignore").decode()
    return next(_NOTE_AUTOMATON.iter(bare), None) is not None


def has_marks(key: str) -> bool:
    """A note or a word of the filler may stand in a line of this skeleton."""
    return next(_MARKS_AUTOMATON.iter(key), None) is not None


def has_latin(key: str) -> bool:
    """A word of the filler stands in a lower-cased text."""
    return next(_LATIN_AUTOMATON.iter(key), None) is not None
