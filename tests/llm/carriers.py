"""Sentences apart from those that the detector of personal data is trained on: other words, other people, other places."""

NAMES = ["Peter Hollis", "Margaret Thornton", "Anita Das", "An Nguyen", "Don Miller", "Long Le", "Zoltán Kerekes", "Ngozi Eze", "Ewa Malinowska", "Sean O'Dowd", "Ama Serwaa Boateng", "Jean-Luc Perrin", "Thornbury, Alice", "MIRA KAPOOR", "Pia van den Broek", "Tariq B. Rahmani", "Guðrún Pálsdóttir", "Marisol Quiroga"]
PHONES = ["(212) 664-7665", "617-253-1000", "+1 415 555 2671", "+44 20 7946 0958", "07911 123456", "+49 30 901820", "0049 89 233-00", "01 42 68 53 00", "+33 6 12 34 56 78", "+34 612 345 678", "+48 501 234 567", "(030) 1234 5678", "1-800-356-9377 ext. 12", "212.555.0188", "+14155552671"]
EMAILS = ["m.thornton@northgate.org", "kerekes_z@posta.hu", "JOBS@ACME.EXAMPLE", "a.das+hr@company.co.uk", "ewa (at) firma (dot) pl", "sean at mail dot example", "info@club.test", "pia[at]broek.nl"]
IDS = ["078-05-1120", "219 09 9999", "QQ 12 34 56 C", "AB123456C", "X1234567L", "P12345678", "D123-4567-8901", "12345678Z"]
ADDRESSES = ["221 Baker Street, London", "1600 Pennsylvania Ave., Washington", "Flat 4, 12 Elm Grove Road, Leeds", "Lindenstraße 14, 10969 Berlin", "Goethestr. 7b, 60313 Frankfurt", "12 rue de Rivoli, 75001 Paris", "Calle de Alcalá 45, 3º B, Madrid", "Via Roma 10, Torino", "742 Evergreen Terrace", "350 Fifth Avenue, Suite 21, New York 10118"]
CARRIERS = {
    "name": ["You may meet {} in the gallery.", "Our treasurer {} keeps the keys.", "It was {} who repaired the boiler.", "I shared an office with {} for two winters.", "Parents of {} asked for a refund.", "Please forward this to {} before lunch.", "Chairperson: {}", "Landlady: {}", "{} scored twice in the second half.", "{} is my dentist.", "The choir is conducted by {}.", "Gestern hat {} den Schlüssel gebracht.", "J'ai rencontré {} à la gare.", "Ayer hablé con {} en la plaza.", "Next of kin: {}", "Respectfully, {}", "Has anyone seen {} since Tuesday?", "Mr. {} bought the bicycle.", "a portrait of {}, oil on canvas", "Minutes taken by {}; next meeting in June."],
    "phone": ["Ring the bell or try {}.", "Our switchboard ({}) opens at eight.", "After hours: {}", "Leave a message at {} please.", "Lost dog, reward, {}!", "Taxi {}", "Bitte melden Sie sich unter {}.", "Contactez-nous au {}.", "Llámame al {} mañana.", "Front desk - {}", "Gate code by SMS from {}.", "(Tel. {})"],
    "email": ["Receipts go to {}.", "Unsubscribe via {}", "Ping {} tomorrow", "[{}]", "Bewerbungen an {} richten.", "Escríbeme a {} cuando puedas.", "the list owner is {}, I think"],
    "id_number": ["Social security number {}", "Passport no. {} expires in May.", "National insurance: {}", "carries identity card {} at all times", "Her SSN ({}) was printed twice.", "DNI {}", "Driving licence {} shown at the desk."],
    "address": ["The parcel shop is at {}.", "Our new home: {}.", "Meet me outside {}.", "They bought {} in spring.", "Send flowers to {}, please.", "Wir wohnen jetzt in der {}.", "Nous habitons {}.", "Deliver only to {}!"],
}
ITEMS = {"name": NAMES, "phone": PHONES, "email": EMAILS, "id_number": IDS, "address": ADDRESSES}
#: Nothing in these is personal.
CLEAN = [
    "The Northern Line was closed on Sunday.", "Green Valley Dairy Ltd delivered twelve crates.", "Senior Pastry Chef wanted in Old Town.", "Season 3 Episode 12 aired on 2021-05-14.", "Invoice 2023-00418, 14 days net.", "Grand Central Station opens at five.", "Our Annual Summer Party starts at noon.", "ISBN 978-3-16-148410-0", "Chapter Seven: Winter Nights", "He teaches Organic Chemistry and Music Theory.", "Load 12.5 kg, range 340-360 km, 230 V.",
    "Model X200-4417, firmware 2.14.3", "The Royal Society met on Friday.", "Blue Cheese Burger, Apple Pie, Iced Tea", "Shares of Harbour Bank AG fell.", "Please read the Terms of Service.", "Rows 100-200 of Table 7", "coordinates 51.5074, -0.1278", "Room 204, Building C", "Der Deutsche Bundestag tagt in Berlin.", "Le Musée du Louvre est fermé.", "We use Continuous Delivery and Pair Programming.",
]
EAST = [("担当者：山本 一郎", "山本 一郎"), ("山田 太郎さんに会いました。", "山田 太郎"), ("姓名：赵明", "赵明"), ("이름: 한지민", "한지민"), ("الاسم: كريم ناصر", "كريم ناصر")]
