"""Page-like texts built from the part table, for the text-extraction jobs."""

PAGE_VIEWS: dict[str, str] = {}

PAGE_VIEWS["detail_pages"] = """
SELECT p.p_partkey AS page_id,
  'https://Host' || cast(p.p_partkey % 50 AS string) || '.example.com/floorplans/a' || cast(p.p_partkey % 40 AS string)
    || CASE WHEN p.p_partkey % 2 = 0 THEN '/' ELSE '?x=1' END AS url,
  '<!DOCTYPE html><html><head><title>' || CASE p.p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'A' || cast(p.p_partkey AS string) || ' | Site'
    WHEN 2 THEN 'Apply Now | Site' WHEN 3 THEN p.p_name || ' - Downtown | Homes' ELSE ' Plan B ' END
  || '</title><meta name="description" content="' || CASE p.p_partkey % 17 WHEN 3 THEN 'Senior Living and Care' ELSE 'Homes for rent' END
  || '"><script>var t="<h1>No</h1> $9,999 7 bed";</script><style>h1{}</style></head><body><!-- ad $8,888 -->'
  || CASE WHEN p.p_partkey % 3 = 0 THEN '<h1>Available Floor Plans</h1>' ELSE '<h1> Schedule a tour </h1>' END
  || CASE p.p_partkey % 4 WHEN 0 THEN '<h2 class="x">Plan ' || cast(p.p_partkey AS string) || '</h2><h3>A' || cast(p.p_partkey % 40 AS string) || '</h3>'
    WHEN 1 THEN '<h2><b>The ' || p.p_name || '</b></h2>' ELSE '' END
  || '<p>Studio - 3 Bedroom Apartments for Rent in a quiet street close to shops, schools and the old market square.</p>'
  || CASE p.p_partkey % 6 WHEN 0 THEN '<div>Studio | 1 Bath | 405-405 SF</div>'
    WHEN 1 THEN '<div>' || cast(1 + p.p_size % 3 AS string) || ' Bedroom | 1.5 Bath | 1,0' || cast(10 + p.p_size AS string) || ' SF</div>'
    WHEN 2 THEN '<div>' || cast(1 + p.p_size % 4 AS string) || ' Bed</div><div>2 Bath</div><div>' || cast(p.p_size * 30 AS string) || ' sq. ft.</div>'
    WHEN 3 THEN '<div>' || cast(p.p_size * 30 AS string) || ' square feet, ' || cast(1 + p.p_size % 4 AS string) || ' bedrooms</div>'
    WHEN 4 THEN '<div>studio</div><div>' || cast(p.p_size * 30 AS string) || ' sqft</div>' ELSE '<div>Ask us</div>' END
  || CASE p.p_partkey % 7 WHEN 0 THEN '<span>Contact</span>' WHEN 1 THEN '<span>Deposit $300</span><span>$2,' || cast(100 + p.p_size AS string) || ' - $2,900</span>'
    WHEN 2 THEN '<b>$1,' || cast(500 + p.p_size AS string) || '</b><i>Base Rent</i>' WHEN 3 THEN 'Base Rent $ 2,450 /mo'
    WHEN 4 THEN '<b>$1,200</b> Base Rent' ELSE '<span>from $' || cast(1400 + p.p_size * 10 AS string) || '</span>' END
  || CASE p.p_partkey % 9 WHEN 0 THEN '<iframe src="https://sightmap.com/embed/abc' || cast(1000 + p.p_partkey AS string) || '"></iframe>'
    WHEN 1 THEN '<div engrain_id="yz' || cast(10000 + p.p_partkey AS string) || '"></div>' WHEN 2 THEN '<a class="jd-fp-floorplan-card" href="/floorplans/a1/">A1</a>'
    WHEN 3 THEN '<script src="https://CDNgeneralmvc.rentcafe.com/x.js"></script>' WHEN 4 THEN '<script>var propertyId = ' || chr(39) || '123' || chr(39) || ';</script>myleasestar.com'
    WHEN 5 THEN '<a href="/floor-plans/b2">B2</a><a href="plans/c3/">C3</a><a href="/floor-plans/b2">again</a><a href="#top">t</a>'
    WHEN 6 THEN '<title>Just a moment</title>Cloudflare checks' WHEN 7 THEN 'rooms per night from $99' ELSE 'fatwin.com' END
  || '<a href="/availability">Availability &amp; Pricing</a><a href="https://www.instagram.com/x">Instagram</a><a href="https://sightmap.com/y">Floor Plans</a>'
  || '<a href="mailto:a@b.c">Contact us</a></body></html>' AS html,
  CASE p.p_partkey % 4 WHEN 0 THEN 'rentcafe' WHEN 1 THEN 'sightmap' END AS hint
FROM part p
"""

PAGE_VIEWS["unit_texts"] = """
SELECT p.p_partkey AS page_id, 'Building ' || cast(p.p_partkey AS string) || chr(10) || 'Studio to 3 Bed'
  || chr(10) || 'HOME ' || cast(100 + p.p_partkey % 900 AS string) || chr(10) || CASE p.p_partkey % 4 WHEN 0 THEN 'Favorite' WHEN 1 THEN 'Request a Tour'
    WHEN 2 THEN 'E303' ELSE 'A' || cast(p.p_partkey % 20 AS string) END || chr(10) || p.p_name || chr(10)
  || CASE WHEN p.p_partkey % 5 = 0 THEN 'Studio / 1 Bath / 420 sq. ft.' ELSE cast(1 + p.p_size % 3 AS string) || ' Bed / 2 Bath / 1,'
    || cast(100 + p.p_size AS string) || ' sqft' END || chr(10) || CASE p.p_partkey % 6 WHEN 0 THEN '$3,412 Base Rent' WHEN 1 THEN 'Base Rent $3,800.50'
    WHEN 2 THEN '$3,445.12 /mo*' WHEN 3 THEN '$ 2,950' WHEN 4 THEN '$99 Base Rent' || chr(10) || '$1,999 per mo' ELSE 'call' END
  || chr(10) || 'Available Jun 4th' || chr(10) || chr(10) || 'APT B' || cast(p.p_partkey % 50 AS string) || chr(10) || 'Plan ' || cast(p.p_size AS string) || 'F'
  || chr(10) || '$' || cast(1000 + p.p_size AS string) || chr(10) || 'waitlist' AS text
FROM part p
"""

PAGE_VIEWS["cards"] = """
SELECT p.p_partkey AS card_id, CASE p.p_partkey % 4 WHEN 0 THEN 'Studio' WHEN 1 THEN cast(1 + p.p_size % 3 AS string) || ' Bedrooms'
    WHEN 2 THEN cast(1 + p.p_size % 3 AS string) || 'br' ELSE 'Loft' END || ' '
  || CASE p.p_partkey % 3 WHEN 0 THEN '1.5 Baths' WHEN 1 THEN '2ba' ELSE '' END || ' '
  || CASE p.p_partkey % 5 WHEN 0 THEN '1,' || cast(100 + p.p_size AS string) || ' sq. ft.' WHEN 1 THEN cast(400 + p.p_size AS string) || ' square feet' ELSE '' END || ' '
  || CASE p.p_partkey % 7 WHEN 0 THEN 'Deposit starting at $1,500 then $2,' || cast(100 + p.p_size AS string) WHEN 1 THEN 'Admin fee: $1,200'
    WHEN 2 THEN 'pet fee $1,050 $' || cast(900 + p.p_size * 10 AS string) || ' today' WHEN 3 THEN '$99 /month special $1,8' || cast(10 + p.p_size AS string)
    WHEN 4 THEN '$ 2,345.50 per month' WHEN 5 THEN 'from $800' ELSE '' END AS text
FROM part p
"""

PAGE_VIEWS["plan_sections"] = """
SELECT p.p_partkey AS page_id, 'Welcome' || chr(10) || 'PLAN 1' || chr(10) || '$2,' || cast(100 + p.p_size AS string) || chr(10) || 'now leasing'
  || chr(10) || cast(400 + p.p_size AS string) || ' - 900' || chr(10) || '1 ' || cast(100 + p.p_partkey % 800 AS string) || chr(10) || '12 months' || chr(10)
  || '$2,' || cast(200 + p.p_size AS string) || chr(10) || CASE WHEN p.p_partkey % 2 = 0 THEN 'Today' ELSE '6/1' || cast(p.p_partkey % 9 AS string) || '/2026' END
  || chr(10) || 'Plan 2' || chr(10) || cast(500 + p.p_size AS string) || chr(10) || CASE WHEN p.p_partkey % 3 = 0 THEN 'sold out' ELSE
    '2 17' || chr(10) || '6 months' || chr(10) || '$ 3,100' || chr(10) || '1/2/2027' END || chr(10) AS text
FROM part p
"""

PAGE_VIEWS["blob_pages"] = """
SELECT p.p_partkey AS page_id, 'https://www.avaloncommunities.com/x/' || cast(p.p_partkey AS string) AS url,
  '<script>Fusion.globalContent={"units":[{"unitName":"' || cast(p.p_partkey AS string) || '-1","floorPlan":{"name":"A' || cast(p.p_partkey % 9 AS string)
  || '"},"bedroomNumber":' || cast(p.p_size % 4 AS string) || ',"bathroomNumber":"1","squareFeet":' || cast(p.p_size * 20 AS string)
  || ',"floorNumber":"3","startingAtPricesUnfurnished":{"prices":{"netEffectivePrice":' || CASE WHEN p.p_partkey % 3 = 0 THEN '0' ELSE cast(2000 + p.p_size AS string) END
  || ',"price":2500},"moveInDate":"2026-06-01T00:00:00Z"},"unitStatus":"' || CASE WHEN p.p_partkey % 5 = 0 THEN 'Leased' ELSE 'VacantAvailable' END
  || '"},{"unitName":null,"floorPlan":{"name":" "}},{"floorPlan":{"name":"B1"},"unitName":"9"}]};  Fusion.x=1;</script>'
  || '<script>ea5.unitAvailability = {"BedroomTypes":[{"AvailableUnits":[{"FloorplanId":"f1","FloorplanName":"One","BestTerm":{"Price":'
  || cast(2000 + p.p_size AS string) || '},"SqFt":0,"Bed":1,"Bath":1,"AvailableDate":"6/12/2026"},{"FloorplanId":"f1","FloorplanName":"One","BestTerm":{"Price":1900},"SqFt":650,"Bed":1,"Bath":1,"AvailableDate":"7/1/2026"},{"FloorplanName":"Two","BestTerm":{},"Bed":2}]}]};' || chr(10) || '</script>'
  || '<script type="application/ld+json">{"@type":"LodgingBusiness","containsPlace":[{"@type":"Accommodation","name":"Alder' || cast(p.p_partkey % 7 AS string)
  || '","numberOfBedrooms":2,"numberOfBathroomsTotal":1},{"@type":"Place","name":"Pool"},{"@type":"Accommodation","name":"Birch"}]}</script>'
  || '<article class="u" data-spaces-obj="unit" data-spaces-sort-plan-name="S1" data-spaces-available="' || CASE WHEN p.p_partkey % 2 = 0 THEN 'true' ELSE 'false' END
  || '" data-spaces-sort-price="' || cast(2100 + p.p_size AS string) || '" data-spaces-sort-area="500" data-spaces-sort-bed="1" data-spaces-sort-bath="1"></article>'
  || '<article data-spaces-obj="unit" data-spaces-sort-plan-name="S1" data-spaces-available="true" data-spaces-sort-price="2500" data-spaces-sort-bed="1"></article>'
  || '<script>setGA4Cookie(~GT~, ~L~, ~3~, ~1449~, ~1449~, ~' || CASE WHEN p.p_partkey % 4 = 0 THEN '0' ELSE cast(6000 + p.p_size AS string) END
  || '~, ~8306~)' || chr(10) || 'setGA4Cookie(~GT~, ~L~, ~3~, ~1~, ~1~, ~1~, ~1~)</script>'
  || '<h2>Alder' || cast(p.p_partkey % 7 AS string) || '</h2><p>2 bed</p>' || CASE WHEN p.p_partkey % 3 = 1 THEN '<p>$' || cast(2200 + p.p_size AS string) || '/mo</p>' ELSE '' END
  || '<h2>Birch</h2>' || CASE WHEN p.p_partkey % 3 = 2 THEN '' ELSE '<p>$2,750 - $2,900/mo</p>' END AS html0
FROM part p
"""
PAGE_VIEWS["blob_pages"] = (
    f"SELECT b.page_id, b.url, replace(b.html0, '~', chr(39)) AS html FROM ({PAGE_VIEWS['blob_pages']}) b"
)
