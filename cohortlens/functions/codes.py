"""Fixed values the results depend on.

FIXED VALUES: these strings must equal the published study setup for the
outputs to match it (templates, code lists, word lists). They are data, kept
together here in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Head templates put in front of every note (by gender). 7 lines each; the
# male file has a single blank on its empty lines, so it is 269 characters
# long against 267 for the female one.
TEMPLATE_F = ("Name:  <name>___</name>         Unit No:   ___\n"
              "\n"
              "Admission Date:  <admission_date>___</admission_date>              "
              "Discharge Date:   <discharge_date>___</discharge_date>\n"
              "\n"
              "Date of Birth:  <dob>___</dob>             Sex:   <sex>F</sex>\n"
              "\n"
              "Address: <address>___</address>\n")
TEMPLATE_M = ("Name:  <name>___</name>         Unit No:   ___\n"
              " \n"
              "Admission Date:  <admission_date>___</admission_date>              "
              "Discharge Date:   <discharge_date>___</discharge_date>\n"
              " \n"
              "Date of Birth:  <dob>___</dob>             Sex:   <sex>M</sex>\n"
              "\n"
              "Address: <address>___</address>\n")

# Race categories left out of the cohort.
EXCLUDED_RACES = ["OTHER", "UNKNOWN", "PATIENT DECLINED TO ANSWER", "UNABLE TO OBTAIN",
                  "MULTIPLE RACE/ETHNICITY"]

# Race code -> race name (21 codes); subgroup code = gender letter + '_' + race code.
RACE_CODES = {
    "AIAN": "AMERICAN INDIAN/ALASKA NATIVE",
    "AS": "ASIAN",
    "AS_AI": "ASIAN - ASIAN INDIAN",
    "AS_CH": "ASIAN - CHINESE",
    "AS_SEA": "ASIAN - SOUTH EAST ASIAN",
    "BL_A": "BLACK/AFRICAN",
    "BL_AA": "BLACK/AFRICAN AMERICAN",
    "BL_CV": "BLACK/CAPE VERDEAN",
    "BL_CI": "BLACK/CARIBBEAN ISLAND",
    "HL": "HISPANIC OR LATINO",
    "HL_CO": "HISPANIC/LATINO - COLUMBIAN",
    "HL_DO": "HISPANIC/LATINO - DOMINICAN",
    "HL_GU": "HISPANIC/LATINO - GUATEMALAN",
    "HL_PR": "HISPANIC/LATINO - PUERTO RICAN",
    "HL_SA": "HISPANIC/LATINO - SALVADORAN",
    "PT": "PORTUGUESE",
    "W": "WHITE",
    "W_BR": "WHITE - BRAZILIAN",
    "W_EE": "WHITE - EASTERN EUROPEAN",
    "W_OE": "WHITE - OTHER EUROPEAN",
    "W_RU": "WHITE - RUSSIAN",
}

# Third-person pronouns that keep their label in the clean-up step.
KEPT_PRONOUNS = ["she", "her", "herself", "he", "his", "him", "himself"]

# "year old" spellings removed after an age label, tried in this order; the
# dot of "y.o" is a regex wildcard.
YEAR_OLD_FORMS = "year old|year-old|years old|yo|y/o|y.o"

# Words written for each gender tag: F, M, and gender switched off.
GENDER_TERMS = {
    #  tag                  F           M          off
    "sex": ("F", "M", "___"),
    "pronoun_subject": ("she", "he", "the patient"),
    "pronoun_object": ("her", "him", "the patient"),
    "pronoun_possessive": ("her", "his", "the patient's"),
    "pronoun_reflexive": ("herself", "himself", "the patient"),
    "form_of_address": ("Ms.", "Mr.", "___"),
    "gendered_noun": ("woman", "man", "___"),
}

# Tags written by the annotator (plus 'address' from the head template).
TAG_VOCABULARY = ["name", "admission_date", "discharge_date", "dob", "age", "sex",
                  "pronoun_subject", "pronoun_object", "pronoun_possessive", "pronoun_reflexive",
                  "form_of_address", "gendered_noun", "race", "spouse", "child",
                  "discharge_instructions", "facility", "attending", "address"]

# Personal-information switches in level order; a level name joins the names
# of the switches that are on: '_name_age_', or '_' when all are off.
LEVEL_ATTRIBUTES = ["name", "address", "age", "visitdates", "gender", "race"]

# Age bands of the prevalence table (inclusive; the last two overlap others).
AGE_BANDS = [(19, 29), (30, 39), (40, 49), (50, 59), (60, 69), (70, 79), (80, 89), (90, 98),
             (19, 50), (74, 96)]

# Age-shift deltas and the age range where a shift stays plausible.
AGE_SHIFTS = [10, 20, -10, -20]
AGE_SHIFT_RANGE = (39, 78)

# Target years of the date shift.
ADMIT_YEAR, DISCHARGE_YEAR_NEXT = 2025, 2026
# ------------------------------------------------------------ END FIXED VALUES

# Race that has no male subgroup in the study; we find such races from the
# data instead (races present with both genders), see operators.pairing.
