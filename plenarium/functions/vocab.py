"""Vocabularies of the text classifiers. All of them are defaults of parameters."""

from __future__ import annotations


def _classes(text: str) -> dict[str, list[str]]:
    """``name: marker, marker`` lines as ordered classes."""
    out = {}
    for line in text.strip().splitlines():
        name, _, markers = line.partition(":")
        out[name.strip()] = [m.strip() for m in markers.split(",") if m.strip()]
    return out


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.replace("\n", " ").split(",") if w.strip()]


# ---- Fixed values: markers by which mentions are classified. Results depend on each of them and on the order of classes.

COHORTS = _classes("""
refugees: refugee, refugees, humanitarian protection, subsidiary protection, displaced, war refugees
asylum_seekers: asylum seeker, asylum seekers, asylum-seeker, asylum-seekers, application for asylum, asylum application, request for asylum
students: student, students, university, universities, study visa, foreign student, foreign students
economic_migrants: economic migrant, economic migrants, labour migrant, labor migrant, workers, seasonal workers, work permit, employment
high_skilled_workers: high-skilled, high skilled, talent passport, researcher, researchers, engineer, engineers, qualified worker, qualified workers
""")

MEASURES = _classes("""
international_law: international law, geneva convention, convention, treaty, european convention, human rights, dublin regulation
national_security: security, terrorism, terrorist, radicalisation, radicalization, public order, threat, criminal, crime
border_control: border, borders, frontier, coast guard, control, controls, crossing, entry, schengen
allocation_of_resources: resources, housing, shelter, places, budget, funding, cost, costs, reception capacity
integration: integration, language, school, education, training, employment, housing, citizenship
returns_deportation: return, returns, deportation, deportations, expulsion, expulsions, removal, readmission
asylum_procedure: asylum procedure, procedure, application, applications, appeal, processing, office for refugees
visas_mobility: visa, visas, residence permit, permit, mobility, regularization, regularisation
""")

AGENCY = _classes("""
learning_emulation_from: model, example, learn from, inspired by, as in, like in, follow, adopt, emulate, copy, best practice, successful, what works, experience of, system in
coercion_intervention_to: force, pressure, sanction, comply, must accept, must take, oblige, impose, intervention, intervene, require, demand, send back, return to, readmission
competition: attractive, compete, competition, more attractive, less attractive, brain drain, talent, rank, compared with, relative to, better than, worse than
exchange_cooperation: cooperate, cooperation, agreement, treaty, joint, partnership, shared, together, bilateral, multilateral, exchange, coordination, solidarity mechanism, european mechanism
""")

POLICY = _words("""
law, laws, legislation, legislative, policy, policies, regulation, regulations, decree, directive, directives, reform, reforms, rule, rules,
act, bill, framework, voted, vote, adopted, adopt, approved, approve, rejected, reject, passed, ratified, ratify, decided, decide, implemented,
implement, applies, apply, introduced, introduce, enacted, enact, government, governments, minister, ministry, ministries, parliament,
parliamentary, chancellor, president, presidency, administration, cabinet, coalition, quota, quotas, regularization, regularisation,
deportation, deportations, naturalization, naturalisation, asylum, visa, visas, residence permit, residency, amnesty, expulsion, expulsions,
readmission, agreement, agreements, treaty, treaties, convention, conventions, pact, pacts, accord, accords, protocol, protocols, model, models,
approach, approaches, system, systems, example, case, experience
""")

SITUATION = _words("""
crisis, crises, emergency, emergencies, wave, waves, flow, flows, influx, exodus, surge, surges, tide, number, numbers, arrivals, arriving,
departures, departing, newcomers, dead, deaths, drowned, drownings, drowning, shipwreck, shipwrecks, tragedy, tragedies, victims, victim, killed,
lost their lives, camp, camps, border, borders, frontier, frontiers, reception centre, reception center, detention, checkpoint, crossing,
crossings, migrants, refugees, asylum seekers, asylum-seekers, displaced, displacement, smugglers, trafficking, unaccompanied minors, war,
conflict, conflicts, civil war, famine, drought, persecution, situation, events, happenings, the mediterranean, mediterranean, channel,
the channel, lampedusa, lesbos, moria
""")

SENTIMENTS = {
    "senti:negneg": ("strong neg", "negative"),
    "senti:mixneg": ("mixed neg", "negative"),
    "senti:neuneg": ("neutral neg", "neutral"),
    "senti:neupos": ("neutral pos", "neutral"),
    "senti:mixpos": ("mixed pos", "positive"),
    "senti:pospos": ("strong pos", "positive"),
}

#: The whole taxonomy (61 frames, the last one the default), in its order of precedence.
FRAMES = _classes("""
economic_contribution: contribution, contribute, growth, tax, labour, labor, workforce
economic_burden: burden, cost, costs, expense, welfare, benefits
labour_shortage: shortage, recruit, seasonal worker, vacancies
skills_talent: talent, high-skilled, qualified, researcher, engineer
student_mobility: student, university, study visa, campus
entrepreneurship: entrepreneur, startup, business, investment
demographic_need: demographic, ageing, aging, birth rate, population decline
humanitarian_obligation: humanitarian, obligation, duty, protection, save lives
solidarity: solidarity, share responsibility, relocation, burden sharing
human_rights: human rights, dignity, fundamental rights, rights
child_protection: children, minor, minors, unaccompanied
family_reunification: family reunification, family, families
gender_vulnerability: women, girls, violence against women, pregnant
victimhood: victim, victims, trafficked, persecuted
cultural_threat: culture, values, way of life, identity, civilization
religious_threat: islam, religion, radical, secularism
national_identity: national identity, nation, republic, citizenship
security_threat: security, threat, danger, risk
terrorism: terrorism, terrorist, radicalisation, radicalization
crime: crime, criminal, delinquency, violence
border_crisis: border, frontier, crossing, coast guard
sovereignty: sovereignty, control our borders, national law
rule_of_law: rule of law, law, legal, illegal
administrative_efficiency: procedure, processing, deadline, administrative
bureaucratic_delay: delay, backlog, waiting, slow
asylum_right: right of asylum, asylum, refugee status
return_deportation: return, deportation, expulsion, removal
detention_control: detention, retention, custody
regularization: regularization, regularisation, amnesty
integration_success: successful integration, integrated, language course
integration_failure: failed integration, communitarianism, ghetto
education: school, education, training
housing_pressure: housing, shelter, accommodation
healthcare: health, hospital, medical
local_capacity: municipality, local, places, capacity
european_solidarity: european solidarity, european mechanism, relocation
eu_failure: europe has failed, failure of europe, dublin failure
schengen_dublin: schengen, dublin regulation, dublin
international_law: international law, geneva convention, convention
bilateral_cooperation: bilateral, agreement with, cooperation with
development_aid: development aid, aid, development policy
root_causes: root causes, causes of migration, poverty, climate
war_conflict: war, conflict, civil war, bombing
climate_migration: climate, drought, famine, environmental
smuggling_trafficking: smuggler, smugglers, trafficking, passeurs
sea_rescue: sea, rescue, shipwreck, drowning, mediterranean
camp_conditions: camp, camps, moria, calais jungle
colonial_history: colonial, colonization, postcolonial
moral_panic: invasion, flood, wave, submersion
technical_management: management, system, database, fingerprint
data_statistics: number, statistics, figures, rate
legal_category: definition, category, status
policy_model: model, example, best practice
policy_failure: failure, ineffective, does not work
competition_attractiveness: attractive, competition, talent
reciprocity_exchange: exchange, reciprocal, partnership
financial_instrument: fund, funding, budget, money
public_opinion: public opinion, citizens think, fear of
electoral_politics: election, vote, party, populism
media_visibility: media, news, images
neutral_reporting:
""")

#: The 18 frames that carry a polarity.
FRAME_POLARITY = {
    "positive_benefit": ["economic_contribution", "skills_talent", "student_mobility", "entrepreneurship"],
    "positive_sympathy": ["humanitarian_obligation", "solidarity", "human_rights", "child_protection", "family_reunification", "victimhood"],
    "negative_risk": ["economic_burden", "cultural_threat", "religious_threat", "security_threat", "terrorism", "crime", "border_crisis", "moral_panic"],
}

CONSEQUENCE = _words("therefore, as a result, will lead to, risk, consequence, because of this")
PRACTICAL = _words("in order to, so that, we must, we should, the aim is, to achieve")
DEFINED = "migration|immigration|asylum|a refugee|refugees|a migrant|migrants|an immigrant|immigrants"
DEFINES = "is|are|means|mean|refers to|consists of|can be defined as"

STOPWORDS = """
a an and are as at be been being but by for from had has have he her his i in is it its may not of on or our she that the their them there these
they this those to was we were which who will with you your
""".split()
CONCRETE = """
airport boat boats border borders camp camps card centre center child children city coast detention document documents family families fingerprint
hospital house housing island judge office passport plane police port prefecture road school ship shelter street territory train visa visas
""".split()
ABSTRACT = """
approach burden citizenship civilization cohesion concept debate dignity duty identity integration justice model morality nation obligation principle
problem responsibility security solidarity sovereignty strategy system value values
""".split()

TOPIC = "immig"
KEYWORDS = _words("refugee, refugees, migrant, migrants, immigrant, immigrants, asylum, asylum seeker, asylum seekers, migration, immigration")
STEMS = _words("migrat, migrant, immigrat, emigrat, refugee, asylum, border, deportat, integration, naturali, citizenship, diaspora, smuggl, traffick, frontex, schengen")

REGIONS = _words("""
Europe, European States, Western Europe, Eastern Europe, Central Europe, Africa, African States, North Africa, Sub-Saharan Africa, West Africa,
Saharan Africa, Asia, Asia Minor, Middle East, Near East, Levant, Maghreb, Sahel, Balkans, Balkan route, Mediterranean, Mediterranean Sea,
Central Mediterranean, Atlantic, North Sea, Black Sea, Aegean Sea, English Channel, Channel, Schengen Area, Schengen, Caribbean, West Indies,
Indian Ocean, Pacific, Sahara, Darfur, Chechnya, Nagorny Karabakh, Kashmir, Overseas Territories
""")
TERRITORIES = _words("""
Mayotte, French Guiana, Guyane, Guyana, Reunion, Réunion, La Réunion, Martinique, Guadeloupe, New Caledonia, Nouvelle-Calédonie, French Polynesia,
Polynesia, Wallis and Futuna
""")
UNION = _words("European Union, EU")
WEOG = "AND AUS AUT BEL CAN CHE DEU DNK ESP FIN FRA GBR GRC IRL ISL ISR ITA LIE LUX MCO MLT NLD NOR NZL PRT SMR SWE TUR USA".split()
EUROPE = """
ALB AND AUT BEL BGR BIH BLR CHE CYP CZE DEU DNK ESP EST FIN FRA GBR GRC HRV HUN IRL ISL ITA LIE LTU LUX LVA MCO MDA MKD MLT MNE NLD NOR POL PRT
ROU RUS SMR SRB SVK SVN SWE UKR VAT XKX
""".split()
#: Other names of a target, by which the annotated track merges its mentions.
ALIASES = {
    "Allemagne": "Germany", "Deutschland": "Germany", "Federal Republic of Germany": "Germany", "German": "Germany", "Italie": "Italy",
    "Italia": "Italy", "Italian": "Italy", "Espagne": "Spain", "España": "Spain", "Spanish": "Spain", "Royaume-Uni": "United Kingdom",
    "Grande-Bretagne": "United Kingdom", "UK": "United Kingdom", "Britain": "United Kingdom", "British": "United Kingdom",
    "Great Britain": "United Kingdom", "England": "United Kingdom", "Hongrie": "Hungary", "Hungarian": "Hungary", "Pologne": "Poland",
    "Belgique": "Belgium", "Pays-Bas": "Netherlands", "Holland": "Netherlands", "Grèce": "Greece", "Turquie": "Turkey", "Maroc": "Morocco",
    "Algérie": "Algeria", "Tunisie": "Tunisia", "Libye": "Libya", "Syrie": "Syria", "Soudan": "Sudan", "Sénégal": "Senegal",
    "États-Unis": "United States", "USA": "United States", "U.S.": "United States", "U.S.A.": "United States", "America": "United States",
    "Guyana": "French Guiana", "Mahorais": "Mayotte", "Anjouan": "Comoros", "EU": "European Union", "US": "United States",
    "Republic of Armenia": "Armenia", "Côte d'Ivoire": "Ivory Coast", "Cote d'Ivoire": "Ivory Coast", "Futuna": "Wallis and Futuna",
    "Mamoudzou": "Mayotte", "Republic of Turkey": "Turkey", "Turkish Republic": "Turkey", "Türkiye": "Turkey", "Turkiye": "Turkey",
    "İstanbul": "Istanbul", "State of Palestine": "Palestine", "Russian Federation": "Russia", "Bosnia": "Bosnia and Herzegovina",
    "Macedonia": "North Macedonia", "Cape Verde": "Cabo Verde", "Congo": "Democratic Republic of the Congo",
}
#: Names that stand for a country in the resolver only: governments, capitals, islands.
RESOLVER_ALIASES = ALIASES | {
    "German government": "Germany", "German Bundestag": "Germany", "Bundestag": "Germany", "Berlin": "Germany", "Deutsch": "Germany",
    "British government": "United Kingdom", "British Parliament": "United Kingdom", "Westminster": "United Kingdom", "London": "United Kingdom",
    "Scotland": "United Kingdom", "Wales": "United Kingdom", "Northern Ireland": "United Kingdom", "United States of America": "United States",
    "Washington": "United States", "White House": "United States", "Italian government": "Italy", "Rome": "Italy", "Lampedusa": "Italy",
    "Sicily": "Italy", "Trieste": "Italy", "Madrid": "Spain", "Ceuta": "Spain", "Melilla": "Spain", "Hellenic Republic": "Greece",
    "Greek government": "Greece", "Athens": "Greece", "Lesbos": "Greece", "Lesvos": "Greece", "Moria": "Greece", "Samos": "Greece",
    "Turkish government": "Turkey", "Ankara": "Turkey", "Istanbul": "Turkey", "Brussels": "Belgium", "Dutch government": "Netherlands",
    "The Hague": "Netherlands", "Warsaw": "Poland", "Budapest": "Hungary", "Orban": "Hungary", "Orbán": "Hungary", "Minsk": "Belarus",
    "Kyiv": "Ukraine", "Kiev": "Ukraine", "Rabat": "Morocco", "Algiers": "Algeria", "Tunis": "Tunisia", "Tripoli": "Libya", "Damascus": "Syria",
    "Khartoum": "Sudan",
}
DOMESTIC = {
    "FRA": ["France", "French Republic", "French", "Republic of France"],
    "GRC": ["Greece", "Greek Republic", "Hellenic Republic", "Greek"],
    "TUR": ["Turkey", "Türkiye", "Turkiye", "Turkish Republic", "Turkish"],
    "ITA": ["Italy", "Italian Republic", "Italian"],
    "GBR": ["United Kingdom", "UK", "Great Britain", "Britain", "British", "England", "Scotland", "Wales", "Northern Ireland"],
}
SHOCKS = {
    "mediterranean_2015": "2015-04-19",
    "cologne_2015": "2015-12-31",
    "brexit_vote": "2016-06-23",
    "moria_fire": "2020-09-09",
    "afghan_withdrawal": "2021-08-15",
    "belarus_crisis": "2021-08-01",
    "ukraine_war": "2022-02-24",
}
#: place, aliases, latitude, longitude, kind
PLACES = [
    ("Calais", ["Calais", "Calaisis"], 50.9513, 1.8587, "city/border area"),
    ("Grande-Synthe", ["Grande-Synthe", "Grande Synthe"], 51.0156, 2.3021, "camp/city"),
    ("Dunkirk", ["Dunkirk", "Dunkerque"], 51.0344, 2.3768, "port city"),
    ("Sangatte", ["Sangatte"], 50.9458, 1.7536, "border area"),
    ("Ouistreham", ["Ouistreham"], 49.2776, -0.2597, "port city"),
    ("Paris", ["Paris", "La Chapelle", "Porte de la Chapelle", "Aubervilliers"], 48.8566, 2.3522, "city"),
    ("Menton", ["Menton"], 43.7745, 7.4975, "border city"),
    ("Briancon", ["Briançon", "Briancon"], 44.8994, 6.6432, "alpine border city"),
    ("Col de l'Echelle", ["Col de l'Échelle", "Col de l'Echelle"], 45.0325, 6.6814, "mountain pass"),
    ("Roya Valley", ["Roya Valley", "Roya"], 43.9387, 7.5144, "border valley"),
    ("Ventimiglia", ["Ventimiglia", "Vintimille"], 43.7912, 7.6076, "border city"),
    ("Lampedusa", ["Lampedusa"], 35.5010, 12.6091, "island"),
    ("Sicily", ["Sicily", "Sicile"], 37.5999, 14.0154, "region/island"),
    ("Rome", ["Rome"], 41.9028, 12.4964, "city"),
    ("Samos", ["Samos", "Samos Island"], 37.7547, 26.9778, "island"),
    ("Lesbos", ["Lesbos", "Lesvos"], 39.1641, 26.3722, "island"),
    ("Moria", ["Moria", "Moria camp"], 39.1322, 26.5162, "camp"),
    ("Crete", ["Crete", "Crète"], 35.2401, 24.8093, "island"),
    ("Aegean Sea", ["Aegean Sea", "Aegean"], 38.5, 25.0, "sea route"),
    ("Evros", ["Evros"], 41.2444, 26.1359, "border region"),
    ("Idomeni", ["Idomeni"], 41.1231, 22.5181, "border village"),
    ("English Channel", ["English Channel", "the Channel", "Channel"], 50.35, 0.0, "sea route"),
    ("Dover", ["Dover"], 51.1279, 1.3134, "port city"),
    ("Kent", ["Kent"], 51.2787, 0.5217, "region"),
    ("London", ["London"], 51.5072, -0.1276, "city"),
    ("Sandhurst", ["Sandhurst"], 51.3469, -0.8038, "agreement place"),
    ("Ceuta", ["Ceuta"], 35.8894, -5.3213, "border enclave"),
    ("Melilla", ["Melilla"], 35.2923, -2.9381, "border enclave"),
    ("Canary Islands", ["Canary Islands", "Canaries"], 28.2916, -16.6291, "islands"),
    ("Belarus-Poland border", ["Belarus-Poland border", "Polish-Belarusian border", "border with Belarus"], 52.1, 23.7, "border"),
    ("Brest", ["Brest"], 52.0976, 23.7341, "border city"),
    ("Mediterranean Sea", ["Mediterranean Sea", "Mediterranean", "Central Mediterranean"], 36.0, 15.0, "sea route"),
    ("Balkan route", ["Balkan route", "Balkans", "Balkan"], 44.0, 20.5, "migration route"),
    ("Dublin", ["Dublin"], 53.3498, -6.2603, "city/policy reference"),
    ("Brussels", ["Brussels", "Bruxelles"], 50.8503, 4.3517, "EU city"),
    ("Berlin", ["Berlin"], 52.52, 13.405, "city"),
    ("Munich", ["Munich", "München"], 48.1351, 11.5820, "city"),
    ("Vienna", ["Vienna", "Vienne"], 48.2082, 16.3738, "city"),
    ("Vilnius", ["Vilnius"], 54.6872, 25.2797, "city"),
    ("Kyiv", ["Kyiv", "Kiev"], 50.4501, 30.5234, "city"),
]
# ---- End of the fixed values.


def read_classes(path: str) -> dict[str, list[str]]:
    """Ordered classes from a text file of ``name: marker, marker`` lines."""
    with open(path, encoding="utf-8") as f:
        return _classes(f.read())
