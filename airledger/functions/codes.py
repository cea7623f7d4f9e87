"""Code tables of licence records: what filed codes mean.

Station classes (over 200 entries) are no table here: pass a two-column table of them to the vocabulary queries.
"""

from __future__ import annotations


def _table(text: str) -> dict[str, str]:
    """code -> label, from lines of a code, a blank and a label."""
    return dict(line.split(" ", 1) for line in text.strip().splitlines())


#: Radio services (fixed values).
RADIO_SERVICES = _table("""
AA Aviation Auxiliary Group
AB Aural Microwave Booster
AC Aircraft
AD AWS-4 (2000-2020 MHz and 2180-2200 MHz)
AF Aeronautical and Fixed
AH AWS-H Block (at 1915-1920 MHz and 1995-2000 MHz)
AI Aural Intercity Relay
AN Antenna Structure Registration
AR Aviation Radionavigation
AS Aural Studio Transmitter Link
AT AWS-3 (1695-1710 MHz, 1755-1780 MHz, and 2155-2180 MHz)
AW AWS (1710-1755 MHz and 2110-2155 MHz)
BA 1390-1392 MHz Band, Market Area
BB 1392-1395 and 1432-1435 MHz Bands, Market Area
BC 1670-1675 MHz Band, Market Area
BR Broadband Radio Service
BS 900 MHz Broadband Service
CA Commercial Air-ground Radiotelephone
CB BETRS
CD Paging and Radiotelephone
CE Digital Electronic Message Service - Common Carrier
CF Common Carrier Fixed Point to Point Microwave
CG General Aviation Air-ground Radiotelephone
CJ Commercial Aviation Air-Ground Radiotelephone (800 MHz band)
CL Cellular
CM Commercial Operator
CN PCS Narrowband
CO Offshore Radiotelephone
CP Part 22 VHF/UHF Paging (excluding 931MHz)
CR Rural Radiotelephone
CT Local Television Transmission
CW PCS Broadband
CX Cellular, Auctioned
CY 1910-1915/1990-1995 MHz Bands, Market Area
CZ Part 22 931 MHZ Paging
DV Multichannel Video Distribution AND Data Service
ED Educational Broadband Service
GB Business, 806-821/851-866 MHz, Conventional
GC 929-931 MHz Band, Auctioned
GE PubSafty/SpecEmer/PubSaftyNtlPlan,806-817/851-862MHz,Conv
GF Public Safety Ntl Plan, 821-824/866-869 MHz, Conv.
GI Other Indust/Land Transp, 896-901/935-940 MHz, Conv.
GJ Business/Industrial/Land Trans, 809-824/854-869 MHz, Conv.
GL 900 MHz Conventional SMR (SMR, Site-Specific)
GM 800 MHz Conventional SMR (SMR, Site-specific)
GO Other Indust/Land Transp, 806-821/851-866 MHz, Conv.
GP Public Safety/Spec Emerg, 806-821/851-866 MHz, Conv.
GR SMR, 896-901/935-940 MHz, Conventional
GS Private Carrier Paging, 929-930 MHz
GU Business, 896-901/935-940 MHz, Conventional
GW General Wireless Communications Service
GX SMR, 806-821/851-866 MHz, Conventional
HA Amateur
HV Vanity
IG Industrial/Business Pool, Conventional
IK Industrial/Business Pool - Commercial, Conventional
IQ Intelligent Transportation Service (Public Safety)
LD Local Multipoint Distribution Service
LN 902-928 MHz Location Narrowband (Non-multilateration)
LP Broadcast Auxiliary Low Power
LS Location and Monitoring Service, Multilateration (LMS)
LV Low Power Wireless Assist Video Devices
LW 902-928 MHz Location Wideband (Grandfathered AVM)
MA Marine Auxiliary Group
MC Coastal Group
MD Multipoint Distribution Service (MDS and MMDS)
MG Microwave Industrial/Business Pool
MK Alaska Group
MM Millimeter Wave 70/80/90 GHz Service
MR Marine Radiolocation Land
MS Multiple Address Service, Auctioned
MW Microwave Public Safety Pool
NC Nationwide Commercial 5 Channel, 220 MHz
NN 3650-3700 MHz
OW FCC Ownership Disclosure Information
PA Public Safety 4940-4990 MHz Band
PB 4940-4990 MHz Public Safety, Base/Mobile
PC Public Coast Stations, Auctioned
PE Digital Electronic Message Service - Private
PF 4940-4990 MHz Public Safety, Pt-to-Pt, Pt-to-Multi-Pt
PK 3.45 GHz Service
PL 3.5 GHz Band Priority Access License
PM 3.7 GHz Service
PW Public Safety Pool, Conventional
QA 220-222 MHz Band, Auctioned
QD Non-Nationwide Data, 220 MHz
QM Non-Nationwide Public Safety/Mutual Aid, 220 MHz
QO Non-Nationwide Other, 220 MHz
QQ Intelligent Transportation Service (Non-Public Safety)
QT Non-Nationwide 5 Channel Trunked, 220 MHz
RP Broadcast Auxiliary Remote Pickup
RR Restricted Operator
RS Land Mobile Radiolocation
SA Ship Recreational or Voluntarily Equipped
SB Ship Compulsory Equipped
SE Ship Exemption
SG Conventional Public Safety 700 MHz
SL Public Safety 700 MHZ Band-State License
SP 700 MHz Public Safety Broadband Nationwide License
SY Trunked Public Safety 700 MHz
TB TV Microwave Booster
TC MSS Ancillary Terrestrial Component (ATC) Leasing
TI TV Intercity Relay
TN 39 Ghz, Auctioned
TP TV Pickup
TS TV Studio Transmitter Link
TT TV Translator Relay
TZ 24 GHz Service
UM Unlicensed Wireless Microphone Registration
UU Upper Microwave Flexible Use Service
VX Instructional Television Fixed Service
WA Microwave Aviation
WM Microwave Marine
WP 700 MHz Upper Band (Block D)
WR Microwave Radiolocation
WS Wireless Communications Service
WT 600 MHz Band
WU 700 MHz Upper Band (Block C)
WX 700 MHz Guard Band
WY 700 MHz Lower Band (Blocks A, B & E)
WZ 700 MHz Lower Band (Blocks C, D)
YB Business, 806-821/851-866 MHz, Trunked
YC SMR, 806-821/851-866 MHz, Auctioned
YD SMR, 896-901/935-940 MHz, Auctioned
YE PubSafty/SpecEmer/PubSaftyNtlPlan,806-817/851-862MHz,Trunked
YF Public Safety Ntl Plan, 821-824/866-869 MHz, Trunked
YG Industrial/Business Pool, Trunked
YH SMR, 806-821/851-866 MHz, Auctioned (Rebanded YC license)
YI Other Indust/Land Transp. 896-901/935-940 MHz, Trunked
YJ Business/Industrial/Land Trans, 809-824/854-869 MHz, Trunked
YK Industrial/Business Pool - Commercial, Trunked
YL 900 MHz Trunked SMR (SMR, Site-Specific)
YM 800 MHz Trunked SMR (SMR, Site-specific)
YO Other Indust/Land Transp. 806-821/851-866 MHz, Trunked
YP Public Safety/Spec Emerg, 806-821/851-866 MHz, Trunked
YS SMR, 896-901/935-940 MHz, Trunked
YU Business, 896-901/935-940 MHz, Trunked
YW Public Safety Pool, Trunked
YX SMR, 806-821/851-866 MHz, Trunked
ZA General Mobile Radio (GMRS)
ZV 218-219 MHz Service
""")

#: Licence statuses (fixed values).
LICENSE_STATUSES = _table("""
A Active
C Canceled
E Expired
L Pending Legal Status
P Parent Station Canceled
T Terminated
X Term Pending
""")

#: Location types (fixed values).
LOCATION_TYPES = _table("""
6 6.1 meter control station
F Fixed
I Itinerant
L Geographic Location
M Mobile
P P35 Centerpoint
T Temporary Fixed
""")

#: Location classes (fixed values).
LOCATION_CLASSES = _table("""
C Centerpoint
L IQ/QQ Area of Operation Desc
P Passive Repeater Location
R Receive Location
T Transmit Location
""")

#: Antenna types (fixed values).
ANTENNA_TYPES = _table("""
H Hub
P Passive Repeater
R Final Receiver
T Transmit Antenna
""")

#: Applicant types (fixed values).
APPLICANT_TYPES = _table("""
B Amateur Club
C Corporation
D General Partnership
E Limited Partnership
F Limited Liability Partnership
G Governmental Entity
H Other
I Individual
J Joint Venture
L Limited Liability Company
M Military Recreation
N Tribal Entity
O Consortium
P Partnership
R RACES
T Trust
U Unincorporated Association
Z Tribal Entity Controlled by a Business
""")

#: Amateur operator classes (fixed values).
OPERATOR_CLASSES = _table("""
A Advanced
E Amateur Extra
G General
N Novice
P Technician Plus
T Technician
""")

#: States, the District of Columbia and territories (fixed values).
USPS_STATES = _table("""
AL Alabama
AK Alaska
AZ Arizona
AR Arkansas
CA California
CO Colorado
CT Connecticut
DE Delaware
DC District of Columbia
FL Florida
GA Georgia
HI Hawaii
ID Idaho
IL Illinois
IN Indiana
IA Iowa
KS Kansas
KY Kentucky
LA Louisiana
ME Maine
MD Maryland
MA Massachusetts
MI Michigan
MN Minnesota
MS Mississippi
MO Missouri
MT Montana
NE Nebraska
NV Nevada
NH New Hampshire
NJ New Jersey
NM New Mexico
NY New York
NC North Carolina
ND North Dakota
OH Ohio
OK Oklahoma
OR Oregon
PA Pennsylvania
RI Rhode Island
SC South Carolina
SD South Dakota
TN Tennessee
TX Texas
UT Utah
VT Vermont
VA Virginia
WA Washington
WV West Virginia
WI Wisconsin
WY Wyoming
AS American Samoa
GU Guam
MP Northern Mariana Islands
PR Puerto Rico
VI U.S. Virgin Islands
""")

#: Full names that stand for a code beside the table's own (fixed values).
OTHER_STATE_NAMES = {"virgin islands": "VI", "us virgin islands": "VI", "united states virgin islands": "VI", "washington dc": "DC"}

#: Weekly service groups, and those built by default (fixed values).
SERVICE_GROUPS = "LMpriv LMcomm LMbcast micro cell market paging coast mdsitfs amat gmrs ship aircr".split()
DEFAULT_SERVICE_GROUPS = SERVICE_GROUPS[:10]

#: Daily file code -> weekly group (fixed values); frc is never built.
DAILY_CODE_GROUPS = _table("""
ac aircr
am amat
cg coast
cl cell
fc frc
gm gmrs
lb LMbcast
lc LMcomm
lp LMpriv
mi mdsitfs
mk market
mw micro
pg paging
sh ship
""")

#: Statuses of live licences; the band of a Priority Access License, in MHz (fixed values).
LIVE_STATUSES = ("A", "L", "X")
PAL_BAND_MHZ = (3550.0, 3650.0)

#: Words that mark an organisation's name (fixed values).
ORGANIZATION_WORDS = (
    "INC LLC CORP CORPORATION CO COMPANY LTD LP LLP PC PA PLLC DBA "
    "CITY COUNTY STATE TOWN TOWNSHIP VILLAGE BOROUGH PARISH DISTRICT AUTHORITY BOARD COMMISSION DEPARTMENT DEPT AGENCY "
    "BUREAU OFFICE GOVERNMENT PUBLIC REGIONAL NATIONAL "
    "TRIBE TRIBES TRIBAL NATION NATIONS INDIAN INDIANS PUEBLO RESERVATION RANCHERIA NATIVE "
    "POLICE SHERIFF FIRE RESCUE AMBULANCE EMS "
    "SCHOOL SCHOOLS COLLEGE UNIVERSITY ACADEMY HOSPITAL MEDICAL CLINIC CHURCH MINISTRIES MINISTRY TEMPLE FOUNDATION "
    "ASSOCIATION ASSN SOCIETY CLUB COUNCIL LEAGUE UNION COOPERATIVE COOP TRUST PARTNERS PARTNERSHIP GROUP HOLDINGS "
    "ENTERPRISES INDUSTRIES "
    "COMMUNITY EDUCATION EDUCATIONAL INSTITUTE CENTER FUND DIOCESE BAPTIST METHODIST "
    "SERVICES SERVICE SYSTEMS COMMUNICATIONS ELECTRIC TELEPHONE WIRELESS RADIO BROADCASTING NETWORK TRANSPORTATION "
    "CONSTRUCTION FARMS FARM RANCH AIRPORT UTILITIES WATER POWER ENERGY BROADBAND TELEVISION TELECOM TECHNOLOGY "
    "TECHNOLOGIES SOLUTIONS CONSULTING TRUCKING PRODUCTIONS MEDIA ALLIANCE ENGINEERING"
).split()


def state_name_key(name: str) -> str:
    """A state's name as it is looked up: lower case, without dots and commas, single blanks."""
    return " ".join(name.lower().replace(".", "").replace(",", "").split())


def state_codes() -> dict[str, str]:
    """State name key -> code."""
    return {state_name_key(v): k for k, v in USPS_STATES.items()} | OTHER_STATE_NAMES
