"""Labelled sentences for the detector of personal data: invented people, numbers and places in phrases as letters, forms, chats and notes have them."""

from __future__ import annotations

import functools
import random

from quillspark.llm import tokens

# Common given names and surnames of many countries; the detector takes both as hints.
GIVEN = (
    "Adam Ahmed Aisha Alan Alejandro Alexander Ali Alice Amina Amy An Ana Anders Andrea Andreas Angela Anita Anna Anne Antonio Arthur Astrid Barbara Beatriz Ben Björn Brian Camille Carlos Carmen Carol Caroline Catherine Charlotte Chen Chloe Christian Christine Claire "
    "Claudia Daniel David Deborah Diana Diego Don Donna Dorota Edward Elena Elif Elizabeth Ella Emily Emma Eric Erik Eva Fatima Felix Fernando Florian Frank François Gabriel George Giulia Grace Hana Hannah Hans Harry Hassan Helen Helena Henry Ian Ibrahim Ines Ingrid Irina Isabel Ivan "
    "Jack Jakub James Jan Jane Jean Jennifer Jessica Joana João Johan John Jonas Jorge José Joseph Juan Julia Julien Karen Karl Katarzyna Katja Kenji Kevin Khalid Klaus Krzysztof Lars Laura Lea Leila Leo Li Lin Linda Lisa Liam Lucas Lucia Luis Łukasz Magdalena Marc Marco Margaret "
    "Maria Marie Mario Mark Marta Martin Mary Mateusz Matthew Max Mehmet Mei Michael Michelle Miguel Mohamed Monika Nadia Natalia Nicole Nikolai Nina Noah Olga Oliver Olivia Omar Pablo Patricia Paul Pedro Peter Philip Pierre Priya Rachel Rafael Raj Rebecca Ricardo Richard Robert Rosa "
    "Ruth Samuel Sandra Sara Sarah Simon Sofia Sophie Stefan Susan Sven Thomas Tim Tomasz Ulrike Victoria Wei William Yuki Yusuf Zofia"
).split()
SURNAME = (
    "Adams Ahmed Ali Allen Almeida Alvarez Anderson Andersson Baker Bauer Becker Bennett Berg Bernard Bianchi Brown Campbell Carter Castro Chan Chen Clark Collins Cooper Costa Cox Das Davies Davis Diaz Dubois Duran Edwards Eriksson Evans Fernandes Fernández Ferrari Fischer Fleming Foster "
    "Fuchs García Gomez González Gray Green Gupta Haddad Hall Hansen Harris Hassan Hernández Hill Hoffmann Hollis Hughes Hussain Ivanov Jackson Jansen Jensen Johansson Johnson Jones Kaplan Kaya Keller Khan Kim King Klein Koch Kovács Kowalski Kruger Kumar Larsen Laurent Le Lee Lefèvre Lewis Li "
    "Lindberg Lopez Martin Martínez Mehta Meyer Miller Mitchell Moore Morales Moreau Moretti Morgan Morris Müller Murphy Nakamura Nguyen Nielsen Nowak Novák O'Brien O'Connor Okafor Olsen Ortiz Osman Park Parker Patel Pereira Perez Petersen Petrov Phillips Popescu Ramirez Reyes Ribeiro Richter "
    "Rivera Roberts Robinson Rodríguez Rojas Romano Rossi Roux Russo Ruiz Sánchez Santos Sato Schmidt Schneider Schulz Schwarz Shah Sharma Silva Singh Smith Sokolov Sørensen Suzuki Takahashi Tanaka Taylor Thompson Torres Turner Usman Vargas Wagner Walker Wang Watson Weber Weiss White Williams "
    "Wilson Wolf Wong Wood Wright Yamada Yang Yılmaz Young Zhang Zimmermann"
).split()
# Names that are also words; the detector has no hint of these.
WORDLIKE = "Mira Ama Sean Will Rose Hope Joy Faith Summer Dean Grant Miles Long Young Chance Luz Paz Dolores Sol Mercedes Bill Art Rich Drew Dale Skip Gene Iris Olive Ivy Sage Violet Sunny Angel Royal Reed Ray Guy Pat".split()
WORDLIKE_LAST = "Banks Bishop Fields Marsh Page Price Rivers Stone Waters Woods Best Bond Cash Church Day Field Fox Frost Gold Grant Joy Knight Lamb Love Major May Moon North Pool Post Short Small Sharp Swan Winter Blanco Guerra Reyes Roth Klug Lang Ganz".split()
# Syllables for names that no list has, and the other parts of the examples.
_ON, _MID, _GIVEN_END, _NAME_END = "b br c ch d dr f g gr h j k kr l m n p r s sh st t tr v w z".split(), "a ae e ei i ia o ou u ü é".split(), "a an e el en i ia ina is o on us ya".split(), "ard berg ek ell er ert ev ez gaard ham ian in ini kamp ley man mann o ott ova owski sen ski son sten stone ström ton uk vik wood".split()
PLACE = ["Lisbon", "Hamburg", "New York", "San José", "São Paulo", "Saint Louis", "Port Louis", "Bad Kissingen", "Los Angeles", "Santa Fe", "Fort Worth", "Novi Sad", "Kuala Lumpur", "Buenos Aires", "Las Palmas", "Tel Aviv", "Baden-Baden", "Salt Lake City", "Mexico City", "Lake Placid", "Villa María", "Monte Carlo", "Ålborg", "Kraków", "Lyon", "Utrecht", "Cape Town", "East Anglia", "North Carolina", "Puerto Rico", "Cambridge", "Springfield"]
PRODUCT = "Aquila Bluebird Corvex Datalith Evergreen Flowmark Gridlock Heliotrope Inkwell Jupiter Keystone Lantern Meridian Nimbus Orbit Polaris Quartz Ripple Sundial Tempest Umbra Vector Waypoint Zephyr".split()
ORG = ["Foods", "Systems", "Energy", "Mobility", "Analytics", "Logistics", "Robotics", "Media", "Health", "Labs", "Partners", "Bank", "Insurance", "University", "Institute", "Hospital", "Airlines", "Software", "Holdings", "Consulting", "Foundation", "Council", "Industries", "Solutions", "Technologies"]
FORM = ["Ltd", "GmbH", "Inc.", "SA", "AG", "LLC", "& Sons", "BV", "Group", "plc", "Corp.", "SpA", "S.L."]
TOPIC = "Data Network Batch Web Stream Quality Model Feature Vendor Supply Query Change Event Load Capacity Schema Domain Threat User Release Service Public Static Mobile Cloud Graph Time Market Budget Field Team Signal Image Search Open Micro Visual Power Spring Oracle Apache Google Microsoft Amazon Adobe Risk Speech Causal Deep Agile Unit Site Stage Customer Product Project Machine Business Technical Financial Digital Human".split()
TASK = "Engineering Modelling Planning Analysis Governance Processing Testing Design Review Monitoring Sourcing Balancing Assessment Negotiation Forecasting Management Mapping Delivery Research Security Quality Inference Lineage Learning Vision Studio Cloud Spark Flow Kafka Excel Basic Engine Server Accessibility Assurance Collaboration Computing Systems Services Applications Speaking Script Recognition Control Operations Migration Lake Code Warehouse Development Architecture Resources Strategy".split()
JOB = ["Branch Manager", "Civil Engineer", "Credit Analyst", "Sound Engineer", "Teaching Assistant", "Line Cook", "Managing Editor", "Policy Adviser", "Game Developer", "Test Pilot", "Sales Director", "Head Nurse", "Vice President", "Project Lead", "Account Executive", "Chief Architect", "Staff Writer", "Senior Consultant", "Interior Designer", "Team Coordinator", "Lab Technician", "Research Scientist", "Night Porter", "Tax Specialist"]
VERB = "Started Launched Sold Painted Tested Joined Wrote Built Led Ran Shipped Taught Rebuilt Measured Closed Opened Planned Replaced Owned Improved Reviewed Tried Moved Kept Added Removed Merged Hosted Organised Translated Automated Using Running Maintaining Introducing Deploying Switching Knows Likes Needs Bought".split()
TEAM = ["platform", "billing", "research", "operations", "compliance", "growth", "support", "payments", "design", "legal"]
THING = ["the invoice", "our quarterly report", "a small pilot", "the new parser", "their onboarding guide", "several tickets", "the night shift", "a spare key", "the second draft", "two dashboards"]
STREET = ["Street", "St.", "St", "Road", "Rd", "Avenue", "Ave.", "Ave", "Blvd", "Boulevard", "Lane", "Ln", "Drive", "Dr", "Way", "Pkwy", "Court", "Ct", "Close", "Row", "Terrace", "Crescent", "Pl", "Place", "Sq", "Square", "Gardens", "Mews"]
GERMAN = ["straße", "strasse", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer"]
TLD = ["com", "org", "net", "de", "fr", "co.uk", "example", "test", "example.org", "io", "eu", "edu"]
LABELS = ["SSN", "SSN:", "social security number", "Social Security no.", "NI number", "NINO", "National Insurance number:", "passport no.", "passport number", "Passport:", "ID", "ID no.", "ID number:", "national ID", "identity card", "identity card no.", "NIE", "NIE:", "DNI", "DNI:", "NIF", "personnummer", "personal identity number", "Personalausweis Nr.", "Ausweisnummer", "driving licence no.", "driving licence", "driver's licence", "driver's license no.", "tax ID", "tax ID:", "Steuer-ID", "PESEL", "CPF", "Reisepass Nr.", "passeport n°"]
# Names and other words of scripts without capitals.
EAST = {
    "ja": (["山田", "佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "小林"], ["太郎", "花子", "健一", "美咲", "翔太", "さくら", "直樹", "陽子"]), "zh": (["王", "李", "张", "刘", "陈"], ["伟", "芳", "秀英", "建国", "小红"]),
    "ko": (["김", "이", "박", "최", "정"], ["민수", "지은", "서연", "준호", "영희"]), "ar": (["محمد", "فاطمة", "أحمد", "ليلى", "يوسف"], ["حداد", "الخطيب", "منصور", "خليل", "سالم"]),
    "he": (["דוד", "שרה", "משה", "רחל"], ["כהן", "לוי", "מזרחי", "פרץ"]), "hi": (["राहुल", "प्रिया", "अमित", "सुनीता"], ["शर्मा", "गुप्ता", "सिंह", "वर्मा"]),
}
EAST_NAME = {"ja": ["氏名：{x}", "名前: {x}", "担当者：{x}", "{x}さんに連絡しました。", "{x}様、お世話になっております。", "連絡先: {x}"], "zh": ["姓名：{x}", "联系人: {x}", "负责人：{x}"], "ko": ["이름: {x}", "담당자: {x}", "{x}님께 연락했습니다.", "{x} 씨가 전화했습니다."], "ar": ["الاسم: {x}"], "he": ["שם: {x}"], "hi": ["नाम: {x}"]}
EAST_NONE = ["所在地：東京 本社", "部署: 開発 部門", "スキル：統計 解析", "件名: 会議 資料", "职位：数据 工程师", "技能: 机器 学习", "부서: 개발 팀", "직책: 데이터 분석가", "المدينة: بيروت", "עיר: תל אביב", "शहर: नई दिल्ली", "会社：日本 電機", "東京都 港区でイベントを開催しました。", "資料は来週 月曜に送ります。", "仕様: 別紙 参照"]


@functools.lru_cache(1)
def words() -> list[str]:
    """The plain lower-case words of a public vocabulary."""
    known = (t[1:].decode() for t in tokens.ranks(tokens.rank_file()) if t[:1] == b" " and t[1:].isalpha() and t.isascii() and t.islower() and 4 <= len(t) <= 13)
    return sorted(w for w in known if w.capitalize() not in GIVEN and w.capitalize() not in SURNAME)


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, mask: str) -> str:
        """The mask with # as digits and A as capitals."""
        return "".join(self.r.choice("0123456789") if c == "#" else self.r.choice("ABCDEFGHKLMNPRSTX") if c == "A" else c for c in mask)

    def made(self, ends: list[str]) -> str:
        r = self.r
        return (r.choice(_ON) + r.choice(_MID) + (r.choice(_ON) + r.choice(_MID) if r.random() < 0.4 else "") + (r.choice("lmnrst") if r.random() < 0.5 else "") + r.choice(ends)).capitalize()

    def given(self) -> str:
        x = self.r.random()
        return self.r.choice(GIVEN) if x < 0.5 else self.r.choice(WORDLIKE) if x < 0.54 else self.made(_GIVEN_END)

    def surname(self) -> str:
        r = self.r
        x = r.random()
        s = r.choice(SURNAME) if x < 0.38 else r.choice(WORDLIKE_LAST) if x < 0.41 else self.made(_NAME_END)
        x = r.random()
        return s if x < 0.8 else f"{s}-{self.made(_NAME_END)}" if x < 0.9 else r.choice(["van der ", "de la ", "von ", "St. ", "El-", "Mac", "O'", "O'", "D’", "di ", "van ", "al-", "de ", "van den "]) + s

    def name(self) -> str:
        r, first = self.r, self.given()
        if r.random() < 0.12:
            first += "-" + self.given()
        x = r.random()
        if x < 0.13:
            return f"{self.surname()}, {first}"
        s = f"{first} {r.choice('ABCDEFGHJKLMNPRSTW')}. {self.surname()}" if x < 0.24 else f"{first} {self.given()} {self.surname()}" if x < 0.34 else f"{first} {self.surname()}"
        return s.upper() if r.random() < 0.14 else s

    def last(self) -> str:
        return self.surname()

    def first(self) -> str:
        return self.r.choice(GIVEN)

    def email(self) -> str:
        r = self.r
        word = lambda: self.made(_NAME_END)
        local = r.choice([f"{self.given()}.{word()}", f"{self.given()}{r.randint(1, 99)}", f"{word()}_{self.given()}", f"{self.given()[0]}{word()}", f"{self.given()}-{word()}+cv", f"{word()}+jobs", "info", "office", f"{self.given()[0]}.{word()}"])
        local = local.encode("ascii", "ignore").decode().lower() or "x"
        domain = self.made(["ex", "ova", "ly", "ix", "um"]).encode("ascii", "ignore").decode().lower() + r.choice(["", "-mail", "", ".mail"]) + "." + r.choice(TLD)
        x = r.random()
        if x < 0.12:
            return f"{local} (at) {domain.replace('.', ' (dot) ')}"
        if x < 0.2:
            return f"{local} at {domain.replace('.', ' dot ')}"
        s = f"{local}[at]{domain}" if x < 0.26 else f"{local} @ {domain}" if x < 0.32 else f"{local}@{domain}"
        return s.upper() if x > 0.94 else s

    def phone(self) -> str:
        masks = [
            "(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "+1 ### ### ####", "+1##########", "+1-###-###-####", "1-###-###-#### ext. ##", "(###) ###-#### x##", "07### ### ###", "07#########", "+44 7### ######", "+44 (0)20 #### ####", "020 #### ####", "+49 30 ##### ###", "0049 30 #####-###", "+49 (0)89 ######", "+49-(0)30-########",
            "0#.##.##.##.##", "+33 # ## ## ## ##", "+34 6## ## ## ##", "+34 ### ### ###", "0# ## ## ## ##", "+48 ### ### ###", "(0##) #### ####", "+7 (###) ###-##-##", "+81-3-####-####", "030/#######", "+39 0# #### ####", "+351 9## ### ###", "+55 11 9####-####", "00## ## ### ## ##", "+91 ##### #####",
        ]
        return self.digits(self.r.choice(masks))

    def ident(self) -> str:
        masks = ["###-##-####", "### ## ####", "QQ ## ## ## A", "QQ######A", "AA######A", "AA ## ## ## A", "P########", "A#######", "X#######A", "Y#######A", "########A", "######-####", "A###-####-####", "##A##-#####", "## ### ### ###", "###########", "AA#######", "###.###.###-##"]
        return self.digits(self.r.choice(masks))

    def strong(self) -> str:
        """An identity number of a form that nothing else has."""
        return self.digits(self.r.choice(["###-##-####", "### ## ####", "QQ ## ## ## A", "QQ######A", "AA ## ## ## A", "P########", "X#######A", "Y#######A", "A###-####-####", "##A##-#####"]))

    def address(self) -> str:
        r = self.r
        street = self.made(["field", "croft", "gate", "mere", "brook", "wood", "hill", "ton", "ley", "ford"])
        if r.random() < 0.3:
            street = r.choice(["Main", "High", "King", "Church", "Mill", "Second", "Lincoln", "Oak", "Park", "Station", "Victoria", "Washington", "Old Mill", "Green Valley"])
        n, x = r.randint(1, 2500), r.random()
        place = self.made(["burg", "haven", "mouth", "ville", "stad", "borg", "ella", "port"]) if r.random() < 0.6 else r.choice(PLACE)
        if x < 0.45:
            s = f"{n} {r.choice(['', '', '', 'N. ', 'SE ', 'West '])}{street} {r.choice(STREET)}"
            s += r.choice(["", "", f", Apt {r.randint(1, 40)}{r.choice('ABC')}", f", Suite {r.randint(1, 99)}"])
            tail = r.choice(["", f", {place}", f", {place} {r.randint(10000, 99999)}"])
        elif x < 0.6:
            s, tail = f"Flat {r.randint(1, 30)}, {r.randint(1, 200)} {street} {r.choice(STREET)}", f", {place}"
        elif x < 0.75:
            s, tail = f"{street}{r.choice(GERMAN)} {r.randint(1, 190)}{r.choice(['', 'a', 'b'])}", r.choice(["", f", {r.randint(10000, 99999)} {place}", f", {r.randint(10000, 99999)} {place}"])
        elif x < 0.87:
            s, tail = f"{r.randint(1, 150)} {r.choice(['rue', 'avenue', 'impasse', 'boulevard', 'place', 'chemin', 'allée', 'quai'])} {r.choice(['de la ', 'du ', 'des ', 'de '])}{r.choice(['Paix', 'Jardins', 'Marché', 'Roses', 'Grand Pré', 'Fontaine'])}", r.choice(["", f", {r.randint(10000, 99999)} {place}", f", {r.randint(10000, 99999)} {place}"])
        else:
            s, tail = f"{r.choice(['Calle', 'C/', 'Avda.', 'Avenida', 'Plaza', 'Paseo', 'Rua', 'Via', 'ul.', 'Viale', 'Camino', 'Corso'])} {r.choice(['de los ', 'del ', 'de la ', '', ''])}{r.choice(['Olivos', 'Mar', 'Mayor', 'Casa Blanca', 'Flores', 'Garibaldi'])} {r.randint(1, 180)}", r.choice(["", f", {r.randint(1, 9)}º {r.choice('ABCD')}, {place}", f", {place}", f", {r.randint(10000, 99999)} {place}"])
        return s + tail

    def product(self) -> str:
        r = self.r
        x = r.random()
        return r.choice(PRODUCT) if x < 0.3 else self.made(_NAME_END) if x < 0.6 else self.made(["ix", "or", "ex", "um", "ara", "tak", "is", "on"])

    def skill(self) -> str:
        r = self.r
        x = r.random()
        if x > 0.65:
            return " ".join(w.capitalize() for w in r.choices(words(), k=r.choice([1, 2, 2, 2, 3])))
        if x < 0.12:
            return f"{r.choice(TOPIC)} {self.product()}"
        if x < 0.2:
            return f"{self.product()} {r.choice(TASK)}"
        if x < 0.24:
            return f"{self.product()} {r.choice(['CSS', 'SQL', 'API', 'UI', 'OS', 'XR', 'CI', 'VM', 'DB', 'Pro', 'JS'])}"
        if x < 0.28:
            return f"{r.choice(TOPIC)} {r.choice(['Sign', 'Plug', 'Stand', 'Check', 'Roll'])}-{r.choice(['On', 'In', 'Up', 'Out'])}"
        return " ".join([*r.sample(TOPIC, r.choice([1, 1, 1, 2])), *([r.choice(TASK)] if r.random() < 0.8 else [])])

    def org(self) -> str:
        r = self.r
        word = self.made(_NAME_END) if r.random() < 0.6 else r.choice(PRODUCT)
        x = r.random()
        return f"{word} {r.choice(ORG)}" + (f" {r.choice(FORM)}" if r.random() < 0.4 else "") if x < 0.55 else f"{word} & {self.made(_NAME_END)} {r.choice(FORM[:3])}" if x < 0.65 else f"{word} {r.choice(FORM)}" if x < 0.85 else f"{r.choice(['University', 'City', 'Bank', 'Museum', 'Port'])} of {r.choice(PLACE)}"

    def caps(self) -> str:
        """Capitalised words that are no name: a heading, a title of a work, a day, a place."""
        r = self.r
        return r.choice([lambda: f"{r.choice(TOPIC)} {r.choice(TASK)}", lambda: f"{r.choice(['Monday', 'Tuesday', 'Friday'])} {r.choice(['Morning', 'Afternoon', 'Night'])}", lambda: f"The {r.choice(TOPIC)} {r.choice(['Report', 'Handbook', 'Festival', 'Times', 'Project', 'Award'])}", lambda: f"{r.choice(PRODUCT)} {r.choice(['Pro', 'Suite', 'One', 'Platform', 'Tower', 'House', 'Day'])}", lambda: f"{r.choice(['Next', 'Final', 'Open', 'Work', 'Key', 'Terms'])} {r.choice(['Steps', 'Points', 'Questions', 'Permit', 'Dates', 'Notes'])}", lambda: f"{r.choice(['North', 'South', 'Old', 'Upper', 'Grand'])} {r.choice(['Wing', 'Station', 'Bridge', 'Valley', 'Market', 'Campus'])}", lambda: r.choice(JOB), lambda: r.choice(PLACE)])()


# What may stand before and after a person in a sentence; every lead meets every tail.
NAME_LEADS = (
    "|I was taught by |We hired |She introduced me to |According to |My neighbour |Yesterday |In the end |Thanks to |Together with |Our landlord, |The nurse, |A friend of mine, |Both |After lunch |Please welcome |Say hello to |The speaker was |The winner is |Ask |Call |I owe this to |This was decided by "
    "|Prepared for |Delivered to |In memory of |On behalf of |Written with |Photo: |Editor: |Teacher: |Witness: |Tenant: |Patient: |Applicant: |Employee: |Full name: |Name: |Contact person: |Attn: |Attention: |From: |To: |CC: |Signed: |Best wishes, |Kind regards,\n|Yours sincerely, |Dear |Hi |Hello |Hallo |Liebe |Lieber |Estimado |Chère "
    "|Ms. |Mrs |Mr. |Mr |Dr. |Dr |Prof. |Frau |Herr |Mme |Señora |Sra. |Sig. |The captain |Our plumber |Sister |Uncle |Painter |Drummer |People like |Children of |The house of |Songs by |Hardly anyone knows |It is |There was |I saw |Then came |Somebody saw |She married |He resembles |Tickets for |A call from |The cook is |Vorsitzende: |heute war |oggi |Ieri |Avec |Luego |with |by |for |from |and |und |et |y |mit |von |avec |par |con |Ansprechpartner: |Verfasser: |Nom : |Nombre: |Nome: |Responsable: |Imię i nazwisko: |Responsible person: |Instructor: |Doctor: |Owner: |Buyer: |Guest: |• |- |(|\"|1. "
).split("|")
NAME_TAILS = (
    "|.|,|;|:|)|\n| said so.| called about {thing}.| wrote {thing}.| will be late.| has left.| was there too.| and {name} agreed.| or {name}| from {place}| of {org}| ({job})|, {job}|, {email}|, {phone}| <{email}>| – {phone}| sent {thing}.| near the door.| at noon.| on {day}.| about {thing}.| when it was over.| kam später.| hat geschrieben.| a appelé hier.| llamó ayer.|'s desk|’s report| (born {year})| is on leave.| as our guest.| to the meeting.| for {thing}.| since {year}.| | | {address}|, {address}|!|?| Then {thing}.| We kept {thing}.| The {team} team.| {verb} {product}.| {verb} {thing}.| {job}| In {year} it ended.| Strong in {skill}.| My {skill} improved.| How was {thing}?| Over {n} weeks {thing}"
).split("|")
POSITIVE = [
    "E-mail: {email}", "email {email}", "My address is {email}, write any time.", "Write to {email}.", "({email})", "<{email}>", "Questions? {email}", "{email}", "{email} / {phone}", "Forwarded from {email} on {day}", "cc: {email}", "Correo: {email}", "Courriel : {email}", "reply-to={email}", "he uses {email} now", "Login {email} was locked.", "The sender, {email}, apologised.",
    "Tel: {phone}", "Telephone {phone}", "Tel.: {phone}", "ph. {phone}", "Mobile: {phone}", "Cell {phone}", "Fax {phone}", "You can ring {phone} until five.", "Call us on {phone}.", "Text {phone} when you arrive.", "({phone})", "{phone}", "My number is {phone}.", "Handy {phone}", "Teléfono: {phone}", "Tél. {phone}", "T {phone} F {phone}", "Hotline {phone} (free)", "reachable under {phone} or {phone}", "WhatsApp: {phone}", "number changed to {phone} last week", "{name}, {phone}", "{name} ({phone})", "{name}: {phone}", "{email}, {phone}", "dial {phone} and wait", "{phone} {date}", "{name}, {phone} {year}-0{d} to now", "{phone} {n} {thing}", "Rückruf bitte unter {phone}.", "appelez le {phone}",
    "{label} {id}", "{label} {id}.", "({label} {id})", "Her {label} is {id}.", "{label}: {id}", "with {label} {id} and a photo", "I enclose a copy; {label} {id}.", "Contract of {name}, {label} {id}", "quoting {label} {id} on the form", "{strong}", "({strong})", "registered as {strong}", "verified: {strong}.", "Holder {name}, {strong}", "the clerk noted {strong} on the form", "{strong} is on record.",
    "Address: {address}", "Adresse: {address}", "Dirección: {address}", "Indirizzo: {address}", "Anschrift: {address}", "She lives at {address}.", "I moved to {address} in {year}.", "Ship it to {address}.", "The flat at {address} is empty.", "{address}", "{name}, {address}", "{name}\n{address}", "Return address: {address}", "billing address {address}", "Er wohnt {address}.", "Vive en {address}.", "J'habite {address}.", "visit us: {address} | {phone}", "{address}, {phone}", "The courier stopped at {address}, then left.", "Place of residence: {address}.", "{name} | {address} | {email} | {phone}", "resident of {address}; {email}",
    "Dr. {last} is away.", "Frau {last} hat angerufen.", "Herr {last}", "Mr {last} paid.", "Mrs. {last}, thank you", "Ms {last} and Mr {last}", "Mme {last} arrive demain.", "Prof. {last} agreed", "Sr. {last}", "Dear {first},", "Hi {first},", "Hello {first}!", "Hallo {first},", "Liebe {first},", "ask {first} about it", "met {first} today",
]
NEGATIVE = [
    "{job}", "Position: {job}", "Role: {job}, {org}", "Employer: {org}", "{org} hired {n} people.", "{org}, {place}", "{job} with {org} in {place}", "City: {place}", "{place} office", "Meeting in {place} on {day}", "Between {place} and {place}", "Flights to {place} were late.", "We moved from {place} to {place}.", "Supplier {org} sent {thing}.", "{org} and {org} merged in {year}.", "approved by {org}", "paid by {org}.", "a letter from {org}", "with {org}", "for {org}", "by {skill}", "with {skill}", "for {skill}", "and {skill}",
    "Skills: {skill}", "Skills: {skill}, {skill}", "Skills: {skill}, {skill}, {skill}, {skill}.", "{skill}; {skill}; {skill}", "{skill} | {skill}", "Knows {skill} and {skill}.", "Courses: {skill}, {skill}", "learned {skill} at {org}", "{skill} ({year})", "certified in {skill}", "Certificate of {skill}, {org}, {year}", "Diploma: {skill}", "Strengths are {skill}, {skill} and {product}.", "used {skill} for {thing}", "{caps}", "{caps}: {thing}", "{caps}.", "On {caps} we met.", "See {caps} for details.", "The {caps} was closed.", "during {caps}", "{caps}, {caps}", "{caps} and {caps}", "Chapter {d}: {caps}", "# {caps}", "{caps}\n", "Dear {job},", "Dear {org},", "Hello Team,", "Dear Sir or Madam", "contact {org}", "Contact: {team} team", "ask the {team} team", "The {team} team met the {team} group.", "written by {org}", "reported to the {job}", "our {job} left", "Name: {product}", "Project name: {product}", "Name: {caps}", "Product: {product} {skill}", "{product} was sold.", "{product} relies on {skill}", "Title: {caps}",
    "ISBN {isbn}", "ISBN: 97{d}-{d}-{n4}-{n4}-{d}", "Invoice {n6}", "Invoice no. {n6}-{n3}", "Order {n6}/{n}", "Ticket {ticket}", "tickets {ticket} and {ticket}", "ref {n3}-{n}-{n}", "Part no. {n4}-{n3}", "Batch {n6}", "lot {n3}-{n3}", "serial {n6}-{n6}", "Version {d}.{n}.{n4}", "v{d}.{d}.{d}", "port {n4}", "build {hash}", "commit {hash}", "{n} x {n} grid", "{n4} x {n4} pixels", "Total {n3} {n3} EUR", "€{n4}.{n}", "$ {n3},{n3}", "{big} rows", "{n3} {n3} {n3} rows were read", "{n4} guests", "p. {n3}-{n3}", "{date}", "{date} to {date}", "from {date} until {date}", "{year}-{year}", "{year}-0{d} to {year}-1{d0}", "born {d}.{d}.{year}", "{d}:{n} - {d}:{n}", "{n}/100", "SLA 99.{n}%", "between {n4} and {n4}", "Room {n3}", "Bus {n}", "Form {n3}-{d}", "code {n4}-{n4}-{n4}", "grid ref {n6} {n6}", "SKU {n6}", "IP 10.{d}.{d}.{n}", "ratio {n}:{n}", "{key}", "{key}, {key}", "issue {key}", "{key} is done", "{ticket} and {key} were closed", "see {key}", "fixed in {key} and {key}.", "page {n} of {n3}", "Budget {n3} {n3} {n3}", "scored {n}.{n}", "latency {n} ms", "part {n3}.{n3}.{n4}", "No. {n4}", "certificate no. {n6}", "in {year} about {n5} users", "sold {n6} units",
    "{n} Main Points", "{n4} Open Questions", "{n} Street lights", "{n} Park Rangers", "{n} Close calls", "No. {n} Court rulings", "{n} Drive failures", "{n} Way points", "{year} Road Map", "package@{d}.{n}.{d}", "thanks @{team}", "ping @{team}-leads", "look at {team} dot", "npm i {team}@{d}", "mention @{product}", "meet at {team} {day}",
    "Skills: {product}, {product}.", "Skills: {product}, {product}, {product}.", "experience with {product}, {product} or both", "Experience with {product}, {product} is a plus.", "experience with {product}, {skill} or more", "Stack: {product}, {product}", "learned {product}, {product}", "Requirements: {product}, {product}", "such as {product}, {product}.", "Skills: {product}, {product} on {product}", "Tools: {product}, {product}", "{product}, {product}, {product}", "in {product}, {product} and {product}", "{skill}, {product}, {product}.", "{product}, {skill}.", "{product} It’s {thing}.", "{skill} It’s late.", "{product} We stayed.", "{product} This helps.", "{skill} What next?", "with {product}, {product}", "knows {product}, {product}.", "{verb} {product}", "{verb} {product} for {n4} people.", "{verb} {product} in {place}.", "{verb} {product} at {org}.", "{verb} {product} with {skill}.", "{verb} {skill}.", "{verb} {skill} for the {team} team.", "{verb} {product} to {n4} guests", "{verb} {product} and {product}", "no need to ask for {skill}", "ask about {skill}", "looking for {skill}", "for {product} with {skill}", "like {skill} or similar", "experience with {skill} or {skill}", "written in {Given}, {n} lines", "{skill}, {Given}, {skill}", "{product} {skill}", "new to {skill}; good at {skill}", "the {product} app", "The {product} {caps}", "{product}, {product}", "{product} – {n} months, {skill}.", "We replaced {product} with {skill}.", "{verb} {org}", "{verb} {caps}", "{verb} {place}",
    "It worked, more or less.", "We kept {thing} and {thing}.", "Nobody read {thing}.", "Why it failed: {thing} took {n} days.", "First, {thing}. Then {thing}.", "They like {skill}.", "Der Bericht war gut; {thing}.", "Die Abteilung {skill} wächst.", "Wir nutzen {skill} und {product}.", "Das Projekt {product} in {place}", "L'équipe {skill} à {place}", "Le projet {product} est fini.", "La empresa {org} creció.", "Experiencia con {skill} y {skill}", "Conhecimentos de {skill}", "Stanowisko: {job}", "Firma: {org}", "Ort: {place}", "Entreprise : {org}", "Puesto: {job}", "The {product} launch in {place} drew {n4} visitors.", "{place}, {place} and {place}", "{thing}, {year}", "On {day} {org} closed.", "During the {caps} at {org}",
]


def sentences(count: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) of ``count`` texts of one to three sentences each."""
    m = Maker(seed)
    r = m.r
    fields = {
        "name": m.name, "first": m.first, "last": m.last, "email": m.email, "phone": m.phone, "id": m.ident, "strong": m.strong, "address": m.address, "org": m.org, "team": lambda: r.choice(TEAM), "job": lambda: r.choice(JOB), "label": lambda: r.choice(LABELS), "caps": m.caps, "thing": lambda: r.choice(THING), "day": lambda: r.choice(["Monday", "Tuesday", "3 May", "Friday", "12 March"]),
        "place": lambda: r.choice(PLACE), "product": m.product, "verb": lambda: r.choice(VERB), "key": lambda: m.digits(r.choice(["AAA-#####", "AAA-####", "AA-#####", "AAAA-####", "AAA-######"])), "Given": lambda: r.choice(GIVEN), "skill": m.skill, "year": lambda: str(r.randint(1995, 2027)), "n": lambda: str(r.randint(1, 99)), "d": lambda: str(r.randint(1, 9)), "d0": lambda: str(r.randint(0, 2)),
        "n3": lambda: str(r.randint(100, 999)), "n4": lambda: str(r.randint(100, 9999)), "n5": lambda: str(r.randint(10000, 99999)), "n6": lambda: str(r.randint(10000, 999999)), "date": lambda: m.digits("20#1-0#-1#").replace("-00", "-01"), "big": lambda: m.digits("#,###,###"),
        "isbn": lambda: m.digits(r.choice(["9##-#-####-###-#", "9##-#-###-#####-X", "97##########"])), "ticket": lambda: m.digits("###-##-##"), "hash": lambda: "".join(r.choice("0123456789abcdef") for _ in range(8)),
    }
    kinds = {"name": "name", "first": "name", "last": "name", "x": "name", "email": "email", "phone": "phone", "id": "id_number", "strong": "id_number", "address": "address"}

    def east() -> str:
        first, second = EAST[lang]
        a, b = r.choice(first), r.choice(second)
        return a + ("" if lang in ("zh", "ko") else " " if lang in ("ar", "he", "hi") else r.choice(["", " ", "　"])) + b

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += r.choice([" ", " ", "\n", "\n\n", "\n- ", " ", " "]) if text else ""
            x = r.random()
            if x < 0.04:
                lang = r.choice(list(EAST))
                t = r.choice(EAST_NAME[lang]) if r.random() < 0.6 else r.choice(EAST_NONE)
                fields["x"] = east
            else:
                t = r.choice(NAME_LEADS) + "{name}" + r.choice(NAME_TAILS) if x < 0.27 else r.choice(POSITIVE) if x < 0.56 else r.choice(NEGATIVE) if x < 0.9 else r.choice(NAME_LEADS) + r.choice(["{org}", "{skill}", "{caps}", "{job}"]) + r.choice(NAME_TAILS)
            while "{" in t:
                before, _, rest = t.partition("{")
                field, _, t = rest.partition("}")
                text += before
                value = fields[field]()
                if field in kinds:
                    spans.append((kinds[field], len(text), len(text) + len(value)))
                text += value
            text += t
        out.append((text, spans))
    return out
