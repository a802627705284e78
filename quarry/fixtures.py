"""Small programs for the text operators."""

PROGRAMS = [
    ("etl", "data work.sales_clean; set work.sales_raw; where amount > 0; margin = amount - cost; run;\nproc sql; create table work.sales_summary as select region, sum(margin) as total from work.sales_clean group by region; quit;\n"),
    ("macro_flow", "%let cutoff = 100;\ndata work.big_orders; set work.orders; if amount >= &cutoff; run;\nproc means data=work.inventory sum mean; var stock; run;\n"),
    ("arrays", "/* scores; doubled */\ndata scored; set raw; array s[3] a b c; do i = 1 to 3; s[i] = s[i] * 2; end; retain total 0; note = 'it''s; fine'; run;\n%macro load(lib); data &lib..x; merge a b; run; %mend load;\n%load(prod)\n"),
    ("merges", "data both; merge left (in=a) right; by id; if a; if first.id then n = 0; run;\n* a remark;\nproc sort data=both out=sorted; by id; run;\nlibname lib '/data';\n"),
    ("open", "options nocenter;\ntitle 'a; b';\nx = 1; y = 2;\n/* never closed"),
]
SCHEMA = "source_id string, text string"
