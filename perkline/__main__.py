from perkline.cli import main

raise SystemExit(main())
