"""A small labelled URL table, written for this library. Each line: host, then paths; every host stands in one of the two lists."""

UNWANTED = """
best-online-poker.info /bonus/signup /play/now.html
lucky-roulette-room.net /deposit/100-free-spins
vegas-slots-jackpot.biz /slots/jackpot /spins?ref=77
sportsbook-betting-tips.info /odds/live-betting
lotto-winner-notice.top /claim/your-prize
prize-giveaway-today.xyz /iphone/winner /claim-now
free-gift-cards-now.club /gift/claim
discount-pharmacy-rx.biz /buy/tablets-no-prescription /order/pills
online-drugstore-cheap.info /buy-generic-pills
weight-loss-miracle.shop /diet-pills/buy /before-after
instant-payday-cash.loan /apply/no-credit-check
quick-cash-advance.biz /loans/bad-credit
credit-repair-fast.info /fix/now
crypto-doubler-profit.top /invest/double-bitcoin
forex-robot-rich.biz /get-rich/trading-bot
make-money-from-home.xyz /earn/5000-a-week /join/now
work-at-home-riches.info /earn-fast
designer-replica-bags.shop /replica/handbags /cheap/luxury
fake-rolex-outlet.biz /replica/watch
cheap-jerseys-outlet.top /wholesale/jerseys
free-movie-torrents.to /torrent/download /magnet/1080p
warez-crack-keygen.ru /crack/serial-key /keygen/download
full-version-cracked.info /download/crack
mp3-free-downloads.biz /free-mp3/download
hot-webcam-girls.xxx /live/cams /adult/chat
adult-dating-tonight.xxx /meet/singles
sexy-singles-nearby.club /dating/hookup
porn-video-tube.xxx /videos/sex /free-porn
escort-services-city.info /escorts/tonight
erotic-stories-archive.xxx /sex/stories
seo-backlinks-cheap.biz /buy/backlinks /links/1000
buy-followers-likes.top /followers/instagram
bulk-email-lists.info /buy/leads
guest-post-links.biz /link-farm/submit
article-spinner-spam.info /spin/article
auto-traffic-bot.xyz /traffic/bot
download-driver-update.top /setup.exe /driver/fix
pc-cleaner-speedup.biz /free-scan/setup.exe
antivirus-alert-warning.xyz /virus/detected
account-verify-login.top /secure/login/verify /bank/update
paypa1-security-check.info /login/confirm
bank-alert-update.xyz /verify/account
parcel-delivery-fee.top /pay/track
tax-refund-claim.club /refund/claim-now
miracle-hair-growth.shop /buy/hair-serum
male-enhancement-pills.biz /enlarge/pills
psychic-love-spells.info /spells/cast
timeshare-exit-deals.biz /deal/exit
cheap-essay-writers.info /buy/essay
fake-diploma-online.top /buy/degree
miracle-cure-detox.shop /detox/cure
bitcoin-gift-faucet.xyz /faucet/claim-free
penny-auction-win.biz /win/auction
celebrity-leaked-nudes.xxx /nude/leaked
royal-casino-club.example /roulette/live /casino/bonus
mega-casino-spins.example /casino/free-spins
online-casinos-ranked.example /casino/review
casino-affiliate-offers.example /refer/casino
live-bet-exchange.example /bet/now
daily-bets-tipster.example /bets/sure-win
bet-big-tonight.example /betting/bonus
horse-bet-insider.example /bet/odds
scratch-and-win-cash.example /win/cash
winners-club-jackpot.example /win/jackpot
bingo-win-rooms.example /bingo/deposit
poker-chips-bonus.example /poker/bonus
slot-machine-mania.example /slots/free
pills-without-doctor.example /pills/order
discount-pills-express.example /pills/cheap
diet-pill-warehouse.example /pill/diet
viagra-cialis-store.example /viagra/buy
rx-meds-overnight.example /meds/no-prescription
steroids-for-sale.example /steroids/buy
cheap-tablets-online.example /tablets/cheap
hgh-and-hormones.example /hormones/buy
spam-mailer-pro.example /spam/bulk
email-spam-tools.example /spam/send
comment-spam-bot.example /spam/auto
link-farm-network.example /farm/links
content-farm-rewriter.example /farm/articles
traffic-farm-clicks.example /clicks/farm
doorway-pages-seo.example /seo/doorway
click-fraud-engine.example /clicks/buy
adult-chat-rooms.example /adult/chat
adult-film-stream.example /adult/videos
adults-only-clips.example /adult/clips
xxx-photo-sets.example /xxx/photos
nude-cam-models.example /nude/cam
sex-toys-discount.example /sex/toys
hookup-tonight-app.example /hookup/meet
milf-finder-local.example /milf/near
mail-order-brides.example /brides/meet
cheap-loans-instantly.example /loans/instant
debt-erase-secrets.example /debt/erase
binary-options-robot.example /options/profit
pump-and-dump-coins.example /coins/pump
crypto-giveaway-double.example /crypto/double
free-coupons-winner.example /free/coupons
free-ringtones-now.example /free/ringtones
free-robux-generator.example /free/robux
free-laptop-survey.example /survey/laptop
cheap-watches-replica.example /replica/cheap
cheap-handbags-store.example /cheap/handbags
cheap-flights-scam.example /cheap/deal
hacked-accounts-shop.example /hacked/accounts
stolen-cards-market.example /cards/dump
torrent-pirate-mirror.example /torrent/pirate
cracked-games-portal.example /cracked/games
keygen-serials-world.example /serial/keygen
phishing-kit-vendor.example /phishing/kit
invoice-overdue-alert.example /invoice/open
wallet-unlock-now.example /wallet/unlock
toolbar-installer-free.example /toolbar/setup.exe
fake-id-printing.example /fake/id
"""

WANTED = """
citylibrary.org /catalogue/search /opening-hours
stateuniversity.edu /admissions/courses /research/physics
riverside-school.org /parents/calendar
natural-history-museum.org /exhibitions/fossils /visit/tickets
botanic-society.net /plants/native
mountain-weather.net /forecast/weekly
regional-newspaper.com /politics/council-vote /2021/03/local-election
daily-herald.net /sport/match-report /opinion/letters
technology-review.com /articles/batteries
open-encyclopedia.org /wiki/Photosynthesis /wiki/Roman_Empire
code-documentation.dev /docs/api/reference /docs/getting-started
software-foundation.org /projects/database /mailing-list/archive
programming-blog.dev /2020/05/parsers-explained
statistics-office.gov /population/census /tables/income
health-ministry.gov /vaccines/schedule
parliament.gov /debates/transcript
city-council.gov /planning/applications
national-archives.gov /records/letters
science-journal.org /articles/doi/climate-model
preprint-server.org /abs/2101.00001
astronomy-club.net /observing/guide
cycling-routes.org /routes/coast
hiking-association.org /trails/lake-loop
kitchen-garden.net /vegetables/tomatoes /compost/how-to
family-recipes.com /soup/lentil /bread/sourdough
music-conservatory.edu /faculty/piano
chamber-orchestra.org /concerts/season
theatre-company.org /plays/hamlet
film-institute.org /archive/silent-era
poetry-magazine.org /poems/autumn
language-course.net /grammar/verbs
dictionary-online.org /entry/etymology
maps-project.org /tiles/region
railway-timetable.net /stations/departures
airport-information.com /arrivals/today
hospital-trust.org /departments/cardiology
veterinary-practice.com /advice/puppies
legal-advice-centre.org /tenants/rights
engineering-society.org /standards/bridges
chemistry-teaching.edu /lessons/acids
geology-survey.gov /maps/bedrock
marine-biology.edu /species/corals
history-of-science.org /people/galileo
archaeology-today.org /excavations/report
local-football-club.net /fixtures/season
chess-federation.org /tournaments/results
bird-watching.org /species/warblers
amateur-radio.net /antenna/dipole
woodworking-forum.net /threads/dovetail-joints
photography-journal.com /tutorials/exposure
travel-notes.blog /japan/kyoto-in-spring
parenting-magazine.com /toddlers/sleep
economics-review.org /papers/inflation
book-reviews.blog /novels/review
river-valley-library.example /catalogue/novels
hill-farm-dairy.example /farm/visits
organic-farm-school.example /farm/lessons
village-bakery.example /bread/rye
mountain-rescue.example /volunteers/training
coastal-path-guide.example /walks/cliff
orchard-growers.example /apples/pruning
beekeepers-union.example /hives/winter
stone-masons-guild.example /apprentices/notes
weavers-workshop.example /looms/patterns
pottery-studio.example /glazes/ash
sailing-school.example /courses/knots
lighthouse-keepers.example /history/lamps
harbour-master.example /tides/today
fishing-village.example /boats/harbour
forest-service.example /trails/closures
wetland-trust.example /birds/herons
butterfly-survey.example /counts/meadow
geometry-notes.example /lectures/triangles
linear-algebra.example /chapters/matrices
number-theory.example /proofs/primes
logic-seminar.example /papers/completeness
compiler-course.example /lectures/parsing
network-protocols.example /rfc/notes
operating-systems.example /kernel/scheduling
robotics-lab.example /projects/arm
solar-energy-lab.example /panels/test
wind-turbine-data.example /measurements/hourly
water-quality.example /rivers/samples
earthquake-watch.example /events/latest
climate-records.example /stations/rain
medieval-studies.example /manuscripts/charters
ancient-languages.example /lexicon/roots
folk-song-archive.example /ballads/north
jazz-history.example /players/trumpet
opera-house.example /season/premiere
puppet-theatre.example /plays/children
silent-cinema.example /directors/comedy
comic-museum.example /strips/early
typography-blog.example /fonts/serif
bookbinding.example /leather/spines
paper-mill.example /rags/history
printing-press.example /type/casting
map-collectors.example /atlas/coast
stamp-society.example /issues/air-mail
model-railway.example /layouts/station
kite-flyers.example /designs/box
rowing-club.example /regatta/results
swimming-pool.example /timetable/lanes
marathon-training.example /plans/beginners
yoga-for-seniors.example /classes/balance
school-nurses.example /advice/fever
dental-health.example /children/brushing
blood-donors.example /centres/booking
winter-tyres-guide.example /tests/snow
bicycle-repair.example /brakes/adjust
neighbourhood-watch.example /meetings/minutes
town-twinning.example /visits/students
allotment-society.example /plots/waiting-list
bus-timetables.example /routes/night
"""
