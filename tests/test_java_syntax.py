import pytest

from weftline.functions.java_syntax import parses

GOOD = [
    "", ";", "package a.b;", "@A package a;", "import a.*; import static a.b.C.d; class X {}",
    "class A<T extends Comparable<T> & B> extends C<D<E>>implements F, G<H[]> { }",
    "public final class A { int a[] = {1, 2,}, b; static { a(); } { } A() { super(); } <T> A(T t) throws E, F { this(1); } ; }",
    "class A { int f(int a, final String... b)[] throws X { return null; } abstract void g(); native int h(A this, int x); }",
    "enum E { A, B(1) { void f() {} }, @X C, ; int x; E() {} } enum F { } enum G { , } enum H { A; }",
    "interface I extends J, K<L> { int X = 1; default void f() {} static <T> T g() { return null; } private void h() {} }",
    "@interface N { int a() default 1; String[] b() default {\"x\", \"y\"}; Class<?> c() default int[].class; }",
    "record P<T>(int x, @A T... y) implements Q { P { x = 1; } static int z; P(int q) { this(q, null); } }",
    "sealed interface S permits A, B { } non-sealed class A implements S { } final class B implements S { }",
    "module a.b { requires transitive c.d; requires static e; exports f to g, h; opens i; uses j.K; provides l.M with n.O; }",
    "class A { void f() { int x = a < b ? c : d; List<Map<String, int[]>> y = new ArrayList<>(); y.<String>g(); this.<T>h(1); } }",
    "class A { void f() { a.forEach(x -> { g(x); }); h((x, y) -> x + y, (int z) -> z, () -> {}, String::valueOf, int[]::new, List<String>::new, A.B[]::new, super::g, this::f, a.b::c); } }",
    "class A { int f(Object o) { return switch (o.g()) { case 1, 2 -> 3; case 4 -> { yield 5; } case A.B -> throw new X(); default -> 6; }; } }",
    "class A { void f() { switch (x) { case 1: case 2: g(); break; case (3): default: } switch (y) { } } }",
    "class A { void f() { if (o instanceof String s && s.g() > 1) return; else if (!(o instanceof final Foo<?> p)) { } } }",
    "class A { void f() { for (;;) ; for (int i = 0, j = 1; i < n; i++, --j) { } for (final var x : xs) { } for (i = 0; ; ) break; l: for (A.B<C> d[] : e) continue l; } }",
    "class A { void f() throws X { try (A a = b(); c; this.d; ) { } try { } catch (X | Y e) { } finally { } try { } finally { } synchronized (this) { } do x--; while (x > 0); } }",
    "class A { void f() { Object a = (String) b; int c = (int) -d; e = (f) - g; h = (A & B) (x) -> y; i = (j) + k; l = (int[]) m; n = (List<String>) o; p = (q) ~r; } }",
    "class A { void f() { int[][] a = new int[3][]; a = new int[][] {{1}, {}}; int b = new int[] { 1, 2 }.length; a[0][1] = b; Outer.Inner c = o.new Inner(1) { int z; }; o.new <T>I<>(); } }",
    "class A { char c = 'x', d = '\\'', e = '\\u0041', f = '\\177'; String s = \"a\\tb\\\"\", t = \"\"\"\n  x \"y\" \\\n z\"\"\"; long l = 0x1F_FFL + 0b1_0 + 017 + 1_000L; double g = 1. + .5e-3f + 0x1p3 + 1e10 + 0f; }",
    "class A { int a = b >> 2 >>> 3 << 4; boolean c = a >= b; void f() { a >>= 1; a >>>= 2; a <<= 3; b >= c; } }".replace(" b >= c;", ""),
    "class A { void f() { var x = 1; final @N int y; class L { } enum M { X } interface N2 { } record R(int a) { } int record = 1; record = 2; yield(3); } }",
    "class A { void f() { assert x : y; assert z; throw new X(); } Class<?> c = void.class, d = String[].class, e = java.lang.String[][].class, g = int.class; }",
    "class A { @Override @SuppressWarnings({\"a\", \"b\"}) @X(a = 1, b = @Y) int f() { return a ? b : c ? d : e; } int x = y ? z -> 1 : w -> 2; }",
    "class A { void f() { ((a)) = b; (c).d++; a[i++] += 2; new A().g(); a = b = c; ++x; A.super.f(); A.this.x = 1; i = j < k & l > m; } }",
    "class \\u0041 { int caf\u00e9 = 1; int $x_1; } \x1a", "class A { /* * / */ // x\n /** y */ }", "class A { int a(List<? extends @X B> c, Map.Entry<?, ? super D[]>... e) { return 1; } }",
    "class A { java.util.@N List<String> a; @N int @M [] b @O []; void g() { if (a) b(); else { } while (true) { ; } } }",
    "class A { int x = f(a < b, c > d); boolean y = i < j && k > l; Object o = a.b.<C>d(); Runnable r = new Runnable() { public void run() { } }; }",
]
BAD = [
    "class", "class A", "class A {", "class A }", "class A { int }", "class A { int x }", "class A { void f() { x } }", "class A { void f() { x; } }", "class A { void f() { a + b; } }",
    "package a", "import a", "import a.*.b;", "class A { void f() { if x { } } }", "class A { void f() { for (int i = 0; i < 3) { } } }", "class A { void f() { int x = ; } }",
    "class A { void f() { return 1 } }", "class A { String s = \"abc; }", "class A { char c = ''; }", "class A { char c = 'ab'; }", "class A { int x = 09; }", "class A { int x = 1__; }",
    "<<<<<<< HEAD\nclass A { }\n=======\n>>>>>>> x", "class A { void f() { g(1, ); } }", "class A { void f() { g(1 2); } }", "class A { void f() { int int = 1; } }", "class A { void f(int) { } }",
    "class A { void f() { try { } } }", "class A { void f() { else { } } }", "class A { void f() { case 1: } }", "class A { int f() { switch (x) { case 1: g(); case 2 -> h(); } } }", "class A { /* }",
    "class A { void f() { a.b. ; } }", "class A { void f() { x = y z; } }", "class A { void f() { (a) = ; } }", "class A { int a = new int[]; }", "class A { int a = new int[2]{1, 2}; }", "class A { # }", "def f(x):\n    return x\n",
    "{\"a\": 1}", "<?xml version=\"1.0\"?><a/>", "version 1\noid 87d8\nsize 12\n", "class A { void f() { do { } while (x) } }", "class A { void f() { int x = (1; } }", "class A { void f() { a ? b : c; } }", "class A extends { }", "class A { public }",
    "class A { void f() { f() = 1; } }", "class A { void f() { 1 = x; } }", "class A { String s = \"\\q\"; }", "class A { int x = a <> b; }", "class A { List<int x; }", "void f() { }", "class A { enum B { A B } }", "class A { int f( { } }", "class A { void f() { x -> y; } }", "class _ { }",
    "class A { String s = \"\"\"abc\"\"\"; }", "class A { void f() { if (a) } }", "class A { void f() { while () { } } }", "class A {} }", "class A { int x = 5 5; }", "class A { void f() { throw; } }", "class A { @Override }", "class A { int f() { return a ? b; } }",
]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert parses(text)


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert not parses(text)
