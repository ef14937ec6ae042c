"""The small labelled table that the tagger of personal data is fitted on, made from sentence patterns by rule.

A pattern holds slots in braces. ``{name}``, ``{email}``, ``{phone}``, ``{id}`` and ``{addr}`` are cases of their kinds;
all other slots, and the words around, are outside. Values are invented here; names are drawn from the table of known
name parts and, as that is incomplete, as often as not from syllables. The number of rows is a parameter.
"""

from __future__ import annotations

import random
import re

KINDS = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "addr": "address"}

CASES = [
    # names
    "Signed, {name}", "Owner: {name}", "Prepared by {name}.", "Reviewed with {name} on {sheet}.", "Reviewed with {name} on {sheet}.", "As {name} told {team}, {cell} is final.", "As {name} told {team}, {cell} is final.", "Attendees: {name}; {team}", "{title} {name} left in {month}.",
    "{title} {name} disagrees with {metric}.", "{name} asked {team} for the {adj} file.", "{name} asked {team} for the {adj} file.", "{name} asked {team} for the {adj} file.", "Name:\t{name}", "Responsable : {name}", "Rédigé par {name}.", "{title} {name} suit le dossier de {place}.",
    "{title} {name} a validé {sheet}.", "Zuständig: {name}", "Erstellt von {name}.", "{title} {name} prüft {sheet}.", "{title} {name} meldet sich aus {place}.", "Preparado por {name}.", "Responsable: {name}",
    "{title} {name} envió el libro.", "{title} {name} firmó {sheet}.", "Regards,\n{name}", "--\n{name}", "Thanks,\n{name}", "Cordialement,\n{name}", "Mit freundlichen Grüßen\n{name}", "Saludos,\n{name}", "{name}", "{name}\n{email}",
    "{name}\n{phone}", "{name}\n{addr}", "{name} | {email}", "{name} | {phone} | {addr}", "{name} | {addr}", "{name};{email}", "{name};{email};{phone}", "| {name} | {email} | {phone} |", "Approved by {name}.", "Contact: {name}", "Employee: {name}",
    '{{"name": "{name}", "email": "{email}"}}', '{{"name": "{name}", "phone": "{phone}"}}', '{{"name": "{name}", "phone": "{phone}", "ssn": "{id}"}}', '{{"email": "{email}", "name": "{name}", "id": "{id}"}}',
    "Name:\t{name}\nEmail:\t{email}", "Name:\t{name}\nPhone:\t{phone}\nId Number:\t{id}", "Id Number:\t{id}\nName:\t{name}", "{name} and {name} met {team} in {month}.", "From: {name} <{email}>", "cc: {name}, {email}",
    "name,email,phone\n{name},{email},{phone}", "{name}\t{email}\t{phone}", "Address:\t{addr}", "Name:\t{name}\nAddress:\t{addr}", '{{"address": "{addr}", "name": "{name}"}}',
    # emails
    "From: {email}", "E-Mail: {email}", "Email:\t{email}", "Contact : {email}", "Correo: {email}", "cc: {email}", "Reach me at <{email}>.", "Questions go to {email}.", "Send the signed form to {email} by {month}.", "{team} shares the inbox {email} now.",
    "Contact ({email}) for the {adj} file.", "Kopie an {email} bis {month}.", "Rückfragen bitte an {email}.", "Copie à {email} avant {month}.", "Merci d'écrire à {email}.", "Copia a {email} antes de {month}.", "Escribir a {email}.", "{email}", "mailto:{email}",
    # phones
    "Tel. {phone}", "Tel.: {phone}", "Tél. : {phone}", "Phone:\t{phone}", "Mobile: {phone}", "Mobil {phone}", "Portable {phone}", "Móvil: {phone}", "fax {phone}", "Fax: {phone}", "Call {phone} after the close.", "My number is {phone}.",
    "Desk line {phone}, ext. {n2}", "Desk line {phone} x{n2}", "Rückruf unter {phone}.", "Llamar al {phone}.", "Appeler le {phone} en {month}.", "Rappeler au {phone} en {month}.", "{phone}", "Phone {phone} or {phone}", "If {sheet} breaks, ring {phone}.", "{name} | {phone}", "| {name} | {phone} | {id} |", "| {name} | {id} | {phone} |", "| {name} | {id} |", "{name};{phone};{id}", "{name};{id}", "{name};{phone}",
    # identity numbers
    "Social security number: {id}", "SSN {id} was typed into {cell}.", "Employee gave {id} as the SSN.", "National ID no. {id}", "Taxpayer ID {id} belongs to the applicant.", "The passport number on page {n2} is {id}.", "Id Number:\t{id}",
    "Personalausweis Nr. {id}", "Steuer-ID: {id}", "Die Reisepassnummer lautet {id}.", "DNI {id}", "El NIE {id} aparece en {cell}.", "Pasaporte n.º {id}", "NIF {id}", "Numéro de sécurité sociale : {id}", "Le NIR {id} figure en {cell}.", "Passeport n° {id}",
    # addresses
    "Home address: {addr}\n{place}, {zip}", "Home address: {addr}", "The applicant lives at {addr}.", "Ship the binder to {addr}, {place} {zip}.", "Site visit at {addr} on the first of {month}.", "Returned mail: {addr}, Unit {n2}, {place}", "Returned mail: {addr}, Apt {n2}, {place} {zip}",
    "Adresse : {addr}, {zip} {place}", "Le demandeur habite {addr}.", "Livraison au {addr}", "Anschrift: {addr}, {zip} {place}", "Wohnhaft {addr}.", "Lieferung an {addr}", "Domicilio: {addr}, {zip} {place}", "Vive en {addr}, {zip} {place}.", "Entregar en {addr}.", "Deliver to {addr} by {month}.", "Lieferung an {addr}\n{zip} {place}", "{name}\n{addr}\n{place}, {zip}",
    "{addr}", "{addr}\n{zip} {place}", "{addr}\n{phone}",
]

OUTSIDE = [
    "The {family} warehouse keeps its own stock sheet.", "Ping @closing-desk once {cell} is locked.", "Install tooling@{n1}.{n2}.0 and rerun the export.", "Grant the reviewers read access before {month}.", "Mark cell {cell} as final and rename the tab.",
    "Purchase order {n3}-{n2}-{n4} was split over two rows.", "Checksum 7f3a{n4}b1 does not match 7f3a{n4}b9.", "Serial {n8}Q was scanned twice at {place}.", "Lot {n5} {n4} {n3} shipped on 20{n2}-0{n1}-{n2}.", "Batch {n4}-{n4} needs a second count.",
    "Part no. {n3}-{n2}-{n4} replaces {n3}-{n2}-{n4}.", "Will the grace period cover {place}?", "Margins rose in {month} and fell again by {month}.", "Meet in room {n2}, Lane B, after the {month} close.", "Rows {n3}-{n4} hold the archive.", "Amounts: {n1} {n3} {n4}; {n2} {n4}; {n2} {n2} {n2}.",
    "See https://docs.corrow.example/v{n2}/close?id={n4} for steps.", "Ticket INC-{n4}-{n2} is closed; see build {n1}.{n2}.{n2}-rc{n1}.", "Invoice {n4}/{n4}/{n4} waits for {team}.", "Formula =SUM({sheet}!{cell}:{cell})*{n1}.{n4} returns an error.", "The {month}–{month} bridge lives on {sheet}, row {n4}.",
    "Rose gold trim for {product} is out of stock.", "The Bill of materials sits on {sheet}.", "Street parking at {place} costs {num}.", "v0{n2} {op} {sheet}!{cell}:{cell} {num} -> {num}", "v0{n2} {op} {sheet}!{cell}:{cell} {num} -> {num}", "v0{n2} {op} {sheet}!{cell}:{cell} {num} -> {num}", "Street parking at {place} costs {num} EUR.", "May and June close on {sheet}.", "Order no. {n3}-{n2}-{n4} ships from {place}.", "Case {n3}-{n3}-{n4} was reopened.",
    "{place} reported {metric} of {num} USD, against a plan of {num} k.", "Costs at {place} rose by {n2}.{n1}% while {metric} barely moved.", "Costs at {place} rose by {n2}.{n1}% while {metric} barely moved.", "{product} ships to {place} in {month}; {team} wants the {adj} forecast first.", "The footer says {month} 20{n2}, the header says {month}, and neither matches {sheet}.",
    "Keep the {adj} rate at {n2}.{n1}% until {place} confirms its {month} count.", "Version {n2} of the workbook was reverted after {team} flagged the merge at {cell}:{cell}.", "Nothing in {sheet} depends on {cell} any more, so the row can go.", "By {month} 20{n2} the {sheet} tab should carry one line per site, {place} included.",
    "After the last apply, {n2} dependents of {cell} on {sheet} came back empty.", "Please read page {n2} of the form before you touch the {adj} totals.", "If {metric} stays under {n2}.{n1}%, {team} will close the {product} line in {month}.", "The deck for {place} repeats slide {n2} twice, and its notes quote {num} EUR instead of {num}.",
    "Range {cell}:{cell} still points at the {adj} inputs; nobody has re-linked it since {month}.", "Search for the {adj} label returned {n2} hits, most of them in old views.", "We moved {metric} from {sheet} to {sheet} so that the {adj} view ties out.", "A named range called {product} feeds {sheet}!{cell}, which in turn drives {metric}.",
    "Freight to {place} was booked under {metric}; the fix touches {cell}:{cell} only.", "{team} asked why {metric} for {place} differs between the memo and the {sheet} tab.", "The table on slide {n2} lists {product} before {product}, and {team} signed that order off.", "{team} reviewed {metric} on the {sheet} sheet and found {cell} off by {n2}.{n1}%.",
    "Cells {cell}:{cell} hold text where numbers were expected, hence the {adj} warning.", "# {product}", "## {sheet}", "Slide {n1}: {product}", "| Site | Metric | Amount | Note |\n| --- | --- | --- | --- |", "| {place} | {metric} | {num} | {adj} |", "| {place} | {metric} | {num} |  |", "Unit: {place}", "Period: {month}", "Quota: {num}", "Site: {team}",
    "Urgency: Routine", "Comment: {num}", "Product: {product}", "v0{n2} set_range {sheet}!{cell}:{cell} {num} -> {num}", "v0{n2} replace_shape_text {sheet}!{cell}:{cell} {num} -> {num}", "[{n2}:{n2}] reviewer: Nothing in {sheet} depends on {cell}.", "[{n2}:{n2}] bot: {product} ships to {place}. :)", "[{n2}:{n2}] owner: thanks 👍",
    "In {cell}:{cell} steht Text, obwohl Zahlen erwartet wurden.", "Nach Fassung {n2} bat {place} um eine teilweise Rücknahme der Änderung.", "Die Fußzeile nennt {month}, die Kopfzeile dagegen {month}.", "Bitte {sheet}!{cell} prüfen, bevor die Mappe nach {place} geht.", "Der Bereich {cell}:{cell} verweist noch auf die alten Annahmen in {sheet}.",
    "Folie {n2} wiederholt eine überholte Tabelle; richtig wäre {num} EUR.", "Im {month} 20{n2} meldete {place} einen Wert von {num} EUR, geplant waren {num} USD.", "Für {place} bleibt die Rohmarge trotz eines Anstiegs um {n2},{n1} % unverändert.", "Liegt der Nettoumsatz über {n2},{n1} %, wird die Reihe {product} im {month} überprüft.", "Die Revision hat der Stückpreis im Blatt {sheet} geprüft und {cell} um {n2},{n1} % berichtigt.",
    "Les cellules {cell}:{cell} contiennent du texte là où l'on attendait des nombres.", "La diapositive {n2} reprend un tableau périmé ; il faut citer {num} USD.", "Merci de vérifier {sheet}!{cell} avant l'envoi du dossier de {place}.", "La plage {cell}:{cell} renvoie encore vers les anciennes hypothèses de {sheet}.", "À {place}, le coût unitaire reste stable malgré une hausse de {n2},{n1} %.",
    "En {month} 20{n2}, le site de {place} affiche {num} k contre {num} prévus.", "Après la version {n2}, la trésorerie a demandé une annulation partielle.", "Le pied de page indique {month}, alors que l'en-tête parle de {month}.", "Si la marge brute dépasse {n2},{n1} %, la gamme {product} sera réexaminée en {month}.",
    "Las celdas {cell}:{cell} contienen texto donde se esperaban números.", "La diapositiva {n2} repite una tabla caducada; debería citar {num}.", "Conviene comprobar {sheet}!{cell} antes de enviar el libro a {place}.", "El rango {cell}:{cell} todavía apunta a los supuestos antiguos de {sheet}.", "En {place}, la merma sigue igual pese a una subida del {n2},{n1}%.",
    "Tras la versión {n2}, compras pidió deshacer parte del cambio.", "El pie de página dice {month} y el encabezado dice {month}.", "En {month} de 20{n2}, la planta de {place} declaró {num} EUR frente a {num} k previstos.", "Si la merma supera el {n2},{n1}%, la línea {product} se revisará en {month}.",
    "Because {cell} on {sheet} logged the auditor, the {adj} spindle at {place} shows {num} where the panel shows {num}.", "Neither the {adj} rebate nor the bale of {place} was mislaid, although {cell}:{cell} lists {n3} ledgers as narrow.", "{product} netted its levy in {place}, priced the {adj} pivot in {month}, and left {n3} leased reels on {sheet}.",
    "Quand le devis est commun, le permis en {cell} doit être inversé ; sinon le compteur de {place} coûte {num} USD.", "Der ländliche Makler aus {place} hat den Vertrag {n3} mal verdoppelt, danach wurde der alte Posten im {month} gewogen.", "El descuento de {place} ha señalado {n2} veces el sello rojo, y luego el saldo de {month} fue movido.", "What does {place} owe in {month}?", "Question: Which cell must change first, and why?",
    "报告 表 {num}", '{{"context": "{num}. Le acompte mixte de"}}', '{{"context": "{num} {place}, {cell}"}}', "{month} {n4}", "{num}", "{sheet}", "{place}", "✅ ok", "QUESTION: HOW LARGE IS THE GAP BETWEEN {place} AND {place}?", "THE {adj} BROKER DOUBLED {n3} TAXABLE SPINDLES WHILE A PANEL NEAR {place} SIGNED THE DOCKET FOR {month}.",
]

FILL = {
    "sheet": "Drivers Digest Basis Checks Opex Capex Lookup Levers Payroll FX Stock Earnings Sites Turnover Steerco Liquidity Revenue Summary".split(),
    "team": ["treasury", "procurement", "payroll", "facilities", "internal audit", "the pricing desk", "the claims team", "customer support", "field operations", "product planning", "Treasury", "Procurement", "The pricing desk", "la trésorerie", "les achats", "le contrôle interne", "l'équipe tarifaire", "die Revision", "das Lagerteam", "die Preisstelle", "die Lohnstelle", "el almacén", "compras", "nóminas", "auditoría interna"],
    "metric": ["gross margin", "net revenue", "backlog", "churn", "unit cost", "scrap rate", "days outstanding", "freight spend", "headcount", "cash conversion", "overtime", "renewal value", "la marge brute", "le délai moyen", "le coût unitaire", "le chiffre d'affaires", "le carnet de commandes", "der Nettoumsatz", "der Stückpreis", "die Rohmarge", "die Fehlerquote", "der Auftragsbestand", "el coste unitario", "la merma", "el ingreso neto", "el margen bruto", "la cartera de pedidos"],
    "adj": ["blended", "one-off", "rolling", "seasonal", "restated", "trailing", "deferred", "weighted", "like-for-like", "unaudited", "BONDED", "frozen"],
    "month": "January February March April May June July August September October November December janvier février mars avril mai juin juillet août septembre Januar Februar März Juni Juli Oktober Dezember enero abril mayo junio agosto septiembre octubre".split(),
    "place": ["Quillbay", "Pellagor", "Hollowford", "Istria Gate", "Lindqvar", "Maravel", "Bexford", "Tamsin Reach", "Upper Fenn", "Northmere", "Dunmarsh", "Corrow", "Ostravale", "Varnholt", "Sel Marina", "Kestrel Point"],
    "product": ["Opal Scale", "Slate Index", "Copper Desk", "Blue Lantern", "Harbor Ledger", "Granite Till", "Tide Router", "Amber Queue", "Delta Loom", "Field Almanac", "Signal Barn", "Paper Kite", "OpalScale", "AmberQueue", "TideRouter"],
    "op": "set_range merge_cells insert_row rotate_page set_cell_value replace_shape_text delete_row".split(),
    "title": ["Ms", "Mr", "Mrs", "Dr.", "Dr", "Mr.", "Ms.", "Herr", "Frau", "Mme", "M.", "Don", "Doña", "La Sra.", "El Sr.", "Prof."],
}

STREETS = {
    "en": ["Saltmarsh Road", "Copper Row", "Harrow Lane", "Fenway Dr.", "St Bride's Close", "N. Lantern Blvd", "Old Weir Avenue", "Mill Street", "Kiln Court", "W. Orchard Way", "Abbey Terrace", "Elm Ave.", "Tollgate Rd", "E. Quarry St.", "Canal Place", "Foundry Square", "Gorse Hill", "Ropewalk Drive"],
    "fr": ["rue des Tanneurs", "avenue du Vieux-Pont", "chemin de la Brume", "boulevard des Cèdres", "place aux Grains", "rue de la Forge", "quai du Port", "impasse des Lilas", "allée du Moulin", "cours Saint-Aubin"],
    "de": ["Mühlenweg", "Kupferstraße", "Lindengasse", "Salzmarktstr.", "Am Alten Wehr", "Bahnhofstr.", "Gartenallee", "Schlossplatz", "An der Furt", "Alte Gasse", "Weidenring", "Im Winkel"],
    "es": ["Calle del Olmo", "Plaza de los Cedros", "C/ Molino Viejo", "Avenida de la Sal", "Calle Mayor", "Avda. del Puerto", "Paseo de la Ribera", "C/ Real", "Camino del Pozo"],
}

#: Words that streets are made of; a group of the lexicon.
STREET_WORDS = frozenset(
    "street st road rd avenue ave blvd boulevard lane ln drive dr close row court ct way terrace square hill place rue chemin quai impasse allée cours bis ter calle plaza avenida avda paseo camino straße strasse str weg gasse platz am n s e w núm".split()
)
TITLE_WORDS = frozenset("ms mr mrs dr herr frau mme m don doña sra sr prof señora señor".split())
#: Words that announce a number of their kind, or one that is none; groups of the lexicon.
DIAL_WORDS = frozenset("tel tél telefon téléphone phone mobile mobil portable móvil fax call ring appeler rappeler llamar rückruf desk line cell".split())
ID_WORDS = frozenset("ssn social security national passport taxpayer dni nie nif nir steuer personalausweis reisepassnummer passeport pasaporte sécurité sociale id tax identity".split())
OTHER_NUMBER_WORDS = frozenset("part purchase order lot serial batch invoice ticket rows amounts case build checksum version row page slide version folie diapositive".split())
SUFFIXES = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring")


def _part(items: list[str], held: int | None, alone: bool) -> list[str]:
    """All items; or, of the distinct ones, all but each third from ``held`` on, or these alone."""
    if held is None:
        return items
    kept = {x for k, x in enumerate(dict.fromkeys(items)) if (k % 3 == held) == alone}
    return [x for x in items if x in kept]


class Maker:
    """Fills patterns. ``held`` leaves out a third of the sentence patterns, places, products and streets, or, ``alone``, takes only these."""

    def __init__(self, given: list[str], family: list[str], seed: int, held: int | None = None, alone: bool = False) -> None:
        self.rng = random.Random(seed)
        self.cases, self.outside = _part(CASES, held, alone), _part(OUTSIDE, held, alone)
        self.values = {k: _part(v, held, alone) if k in ("place", "product", "team") else v for k, v in FILL.items()}
        self.streets = {k: _part(v, held, alone) for k, v in STREETS.items()}
        self.given_parts, self.family_parts = given or ["Ada"], family or ["Lovel"]

    def _invented(self, low: int, high: int) -> str:
        r = self.rng
        syllables = "bel cor dan el fen gar hil is jor kas lud mae nor ol pen quin ros stor tob vel wyn yar zan bran ev ott tav mir ha den ros gro vesp quess hag nord crow".split()
        ends = "a er in ric wen tine lis dore mar wyn son ley ner bach ton elle iah mille line aint mond kov qvarn along tin aux".split()
        return ("".join(r.choice(syllables) for _ in range(r.randint(low, high))) + r.choice(ends)).capitalize()

    def given(self) -> str:
        return self.rng.choice(self.given_parts) if self.rng.random() < 0.6 else self._invented(1, 2)

    def family(self) -> str:
        return self.rng.choice(self.family_parts) if self.rng.random() < 0.6 else self._invented(1, 2)

    def name(self) -> str:
        r = self.rng
        g, f = self.given(), self.family()
        form = r.random()
        if form < 0.55:
            out = f"{g} {f}"
        elif form < 0.68:
            out = f"{g} {r.choice('ABCDEGHJKLMNRST')}. {f}"
        elif form < 0.80:
            out = f"{g[0]}. {f}"
        elif form < 0.92:
            out = f"{f}, {g}"
        else:
            out = f"{f.upper()}, {g}"
        case = r.random()
        return out.upper() if case < 0.07 else out.lower() if case < 0.14 else out

    def email(self) -> str:
        r = self.rng
        plain = lambda s: re.sub(r"[^a-z-]", "", s.lower())
        g, f = plain(self.given()) or "a", plain(self.family()) or "b"
        local = r.choice([f"{g}.{f}", f"{f}_{g}", f"{g}{r.randint(1, 99)}", f"{g[0]}{f}", f"{g}.{f}+close", f"{g.capitalize()}.{f.capitalize()}", f"{g}{f}"])
        domain = r.choice(["quillbay.example", "pellagor.example", "corrow.example", "mail.northmere.test", "sub.varnholt.test", "ledger-desk.invalid", "office.example.org", "post.example.com"])
        form = r.random()
        if form < 0.6:
            out = f"{local}@{domain}"
        elif form < 0.7:
            out = f"{local}(at){domain}"
        elif form < 0.8:
            out = f"{local} [at] {domain.replace('.', ' [dot] ')}"
        elif form < 0.9:
            out = f"{local} at {domain.replace('.', ' dot ')}"
        else:
            out = f"{local} @ {domain}"
        return out.upper() if r.random() < 0.06 else out

    def _digits(self, pattern: str) -> str:
        return "".join(str(self.rng.randint(0, 9)) if c == "9" else self.rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "L" else c for c in pattern)

    def phone(self) -> str:
        forms = ["999-555-0199", "(999) 555-0199", "999.555.0199", "999 555 0199", "999‑555‑0199", "+1 999 555 0199", "+1-999-555-0199", "9995550199", "19995550199", "19995550199", "19995550199", "020 7946 0999", "(0119) 496 0999", "0119 496 0999", "+44 20 7946 0999", "+44 (0)20 7946 0999", "07700 900999",
                 "01 99 00 99 99", "01.99.00.99.99", "06 39 98 99 99", "+33 1 99 00 99 99", "+33 6 39 98 99 99", "030 23125 999", "030/23125999", "0152 28817999", "+49 30 23125999", "+49 (0)30 23125-999", "+49 152 28817999", "600 00 09 99", "900-000-999", "600-000-999", "+34 600 000 999", "+34 600 00 09 99", "+34 900-000-999", "+1 (999) 555-0199"]
        return self._digits(self.rng.choice(forms))

    def id(self) -> str:
        forms = ["999-99-9999", "999 99 9999", "999999999", "L99999999", "L99999999", "99 999 999 999", "99999999999", "L9L99L99L9", "L99LL9999", "99999999-L", "99999999L", "L9999999L", "9 99 99 99 999 999 99", "999999999999999", "99LL99999", "L9LL9L9999"]
        return self._digits(self.rng.choice(forms))

    def addr(self) -> str:
        r = self.rng
        lang = r.choice(["en", "en", "en", "fr", "de", "es"])
        street = r.choice(self.streets[lang])
        if r.random() < 0.35:
            new = self._invented(1, 2)
            street = {"en": f"{new} {r.choice(['Street', 'Road', 'Avenue', 'Lane', 'Close', 'Dr.', 'Blvd', 'Row'])}", "fr": f"{r.choice(['rue', 'avenue', 'place', 'chemin'])} {r.choice(['de', 'du', 'des'])} {new}", "de": f"{new}{r.choice(['straße', 'weg', 'gasse', 'platz', 'str.'])}", "es": f"{r.choice(['Calle', 'Plaza', 'Avenida', 'C/'])} {r.choice(['del', 'de la', 'de los'])} {new}"}[lang]
        n = str(r.randint(1, 499))
        if lang == "en":
            out = f"{n}{r.choice(['', '', '', 'a', 'B'])} {street}"
        elif lang == "fr":
            out = f"{n}{r.choice(['', '', ' bis', ' ter'])}{r.choice([' ', ', '])}{street}"
        elif lang == "de":
            out = f"{street} {n}{r.choice(['', '', 'a'])}"
        else:
            out = f"{street}{r.choice([' ', ', ', ', núm. ', ' nº '])}{n}"
        if r.random() < 0.15:
            blanks = [m.start() for m in re.finditer(" ", out)]
            at = r.choice(blanks)
            out = out[:at] + "\n" + out[at + 1 :]
        return out.upper() if r.random() < 0.12 else out

    def other(self, slot: str) -> str:
        r = self.rng
        if slot == "cell":
            return r.choice(["", "A"]) + r.choice("ABCDEFGHKLMNPRSTUVWZ") + str(r.randint(1, 399))
        if slot == "num":
            return r.choice([f"{r.randint(1, 9)},{r.randint(100, 999)},{r.randint(100, 999)}", f"{r.randint(1, 99)}.{r.randint(0, 99)}", f"{r.randint(1, 9)}.{r.randint(100, 999)}.{r.randint(100, 999)},{r.randint(0, 99)}", f"{r.randint(1, 9)} {r.randint(100, 999)} {r.randint(100, 999)}", str(r.randint(1, 9999)), f"{r.randint(1, 9)},{r.randint(100, 999)}.{r.randint(0, 9)}"])
        if slot == "zip":
            return self._digits("99999")
        if slot == "family":
            return r.choice(self.family_parts)
        if slot[0] == "n" and slot[1:].isdigit():
            return self._digits("9" * int(slot[1:]))
        return r.choice(self.values[slot])

    def fill(self, pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, size = [], [], 0
        for part in re.split(r"(\{\w+\}|\{\{|\}\})", pattern):
            if part in ("{{", "}}"):
                value = part[0]
            elif part[:1] == "{" and part[-1:] == "}" and len(part) > 2:
                slot = part[1:-1]
                value = getattr(self, slot)() if slot in KINDS else self.other(slot)
                if slot in KINDS:
                    spans.append((size, size + len(value), KINDS[slot]))
            else:
                value = part
            out.append(value)
            size += len(value)
        return "".join(out), spans

    def block(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A pattern filled in, now and then behind what such lines begin with, or in capitals or small letters throughout."""
        r = self.rng
        if r.random() < 0.08:  # a table
            row = "| {place} | {metric} | {num} | "
            return self.fill("| Site | Metric | Amount | Note |\n| --- | --- | --- | --- |\n" + "\n".join(row + r.choice(["{adj} |", " |", "{adj} |", r.choice(self.outside).split("\n")[0] + " |"]) for _ in range(r.randint(1, 4))))
        inside = r.random() < 0.55
        pattern = r.choice(self.cases) if inside else r.choice(self.outside)
        if r.random() < 0.25:
            pattern = r.choice(["- ", "- ", "| ", "| {place} | {metric} | {num} | ", "[{n2}:{n2}] owner: ", "[{n2}:{n2}] analyst: ", "Slide {n1}: {product} ", "Slide {n1}: {product}\n", "Unit: ", "Unit: {month} ", "Period: {num} ", "Comment: ", "Site: {place} ", "Quota: ", "{product} ", "✅ ", "表 "]) + pattern
        if r.random() < 0.08:
            pattern += r.choice([" 👍", " :)", " |", " 📊", " ✅ ok"])
        text, spans = self.fill(pattern)
        case = r.random()
        if not inside and case < 0.1 and len(text.upper()) == len(text):
            text = text.upper()
        elif not inside and case < 0.2 and len(text.lower()) == len(text):
            text = text.lower()
        return text, spans

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text of a few lines with its spans."""
        r = self.rng
        blocks = [self.block() for _ in range(r.randint(1, 4))]
        if r.random() < 0.15:
            blocks.append(self.fill(r.choice(["Regards,\n", "Regards,\n", "--\n"]) + "{name}\n" + "\n".join(r.sample(["{email}", "{phone}", "{addr}"], r.randint(1, 3)))))
        if r.random() < 0.10:
            blocks.append(self.fill(r.choice(["Regards,\n", "--\n", ""]) + "{name} | " + " | ".join(r.sample(["{email}", "{phone}", "{addr}"], r.randint(1, 2)))))
        text, spans = "", []
        for k, (more, found) in enumerate(blocks):
            if k:
                text += r.choice(["\n", "\n", "\n\n", " ", "\n \n", "\r\n"])
            spans += [(a + len(text), b + len(text), kind) for a, b, kind in found]
            text += more
        return text, spans


def labelled_rows(given: list[str], family: list[str], rows: int = 4000, seed: int = 7, held: int | None = None, alone: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    maker = Maker(given, family, seed, held, alone)
    once = [maker.fill(p) for p in maker.cases + maker.outside]
    return once + [maker.row() for _ in range(max(0, rows - len(once)))]
